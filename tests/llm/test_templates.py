import math

from helpers import ODD_ROWS, write
from pyspark.sql import functions as F

from townsheet.llm import common, queries, templates

ITEMS = [
    (0, "Alice buys 3 apples and 12 pears for Bob at 4.50 dollars, then Alice walks 7 km to the old market by the river."),
    (1, "the small brown fox jumps over a very lazy dog near those green hills today and sleeps"),
    (2, "too short to count"),
    (3, None),
    (4, "the small brown fox jumps over a very lazy dog near those green hills today and sleeps"),
]
SAME = "Carol buys 5 apples and 90 pears for Dave at 1.25 euros, then Carol walks 2 miles to the old market by the river."
MIXED = "Carol buys 5 apples and 90 pears for Dave at 1.25 euros, then Erin walks 2 miles to the old market by the river."
DOCS = [
    (10, f"Intro words come first here. {ITEMS[0][1]} And some words after.", "en", "s", 0),
    (11, f"Intro words. {SAME} The end of it.", "en", "s", 0),
    (12, f"Intro words. {MIXED} The end of it.", "en", "s", 0),
    (13, f"x y z {ITEMS[1][1]}", "en", "s", 0),
    (14, "the small brown fox jumps over a cat and then some other things happen that no one had seen", "en", "s", 0),
    (15, "Alice Bob Carol Dave Erin Frank 1 2 3 4 5 6 7 8 9 10 11 12", "en", "s", 0),
    (None, ITEMS[1][1], None, None, None),
    *ODD_ROWS,
]


def run(spark, tmp_path, docs, items=ITEMS):
    path = write(spark, docs, tmp_path, extra=True)
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return queries.op2_benchmark_decontamination(spark, path).collect()


def test_query(spark, tmp_path):
    got = run(spark, tmp_path, DOCS)
    assert len(got) == len(DOCS)
    flagged = sorted(((r.doc_id, r.item_ids, r.changed) for r in got if r.contaminated), key=str)
    assert flagged == sorted([(10, "0", False), (11, "0", True), (13, "1", False), (None, "1", False)], key=str)
    assert not any(r.contaminated for r in run(spark, tmp_path, DOCS, []))
    assert run(spark, tmp_path, []) == []


def test_shuffled_when_too_large_to_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert {r.doc_id for r in run(spark, tmp_path, DOCS) if r.contaminated} == {10, 11, 13, None}


def brute(docs, items):
    """Eight-word windows of literal texts, for texts in lower case without digits."""
    index = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 7):
            index.setdefault(tuple(w[k : k + 8]), []).append((i, k, len(w) - 7))
    out = set()
    for d, t in docs:
        w, lines = t.split(), {}
        for k in range(len(w) - 7):
            for i, j, n in index.get(tuple(w[k : k + 8]), ()):
                for strip in ((k - j) // 8 * 2, (k - j + 4) // 8 * 2 + 1):
                    lines.setdefault((i, strip, n), set()).add(j)
        if any(len(v) >= min(6, math.ceil(key[2] * 0.3)) for key, v in lines.items()):
            out.add(d)
    return out


def test_literal_texts_like_brute_force(spark, tmp_path):
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rnd.randint(9, 30)))) for i in range(12)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(40)]
        if d % 2:
            part = rnd.choice(items)[1].split()
            a = rnd.randint(0, 5)
            w[10:10] = part[a : a + rnd.randint(7, 20)]
        docs.append((d, " ".join(w), "en", "s", 0))
    got = {r.doc_id for r in run(spark, tmp_path, docs, items) if r.contaminated}
    assert got == brute([d[:2] for d in docs], items) and len(got) > 10


def test_every_item_of_a_template(spark, tmp_path):
    text = "{} has {} apples and {} pears in the small basket that stands by the old kitchen door all day long"
    items = [(0, text.format("Ann", 5, 5)), (1, text.format("Bob", 3, 5)), (2, text.format("Bob", 3, 5)), (3, text.format("Eve", 7, 8))]
    docs = [(i, f"so it goes that {text.format(*v)} and so on", "en", "s", 0) for i, v in enumerate([("Bob", 3, 5), ("Ann", 5, 5), ("Joe", 9, 9), ("Joe", 1, 2)])]
    got = {r.doc_id: (r.item_ids, r.n_items, r.changed) for r in run(spark, tmp_path, docs, items)}
    # an item with one value in two slots does not fit two values; equal values in the document fit any item
    assert got == {0: ("1,3", 2, False), 1: ("0,1,3", 3, False), 2: ("0,1,3", 3, True), 3: ("1,3", 2, True)}
    assert templates.clean(*[spark.createDataFrame(r, s) for r, s in ((docs, "doc_id long, text string, lang string, source string, n_chars long"), (items, "item_id long, text string"))]).count() == 0


def test_template(spark):
    text = "In 2020, Ana-Maria ran 3.5 km (5km) iPhone, 7 days. NASA's 1,000 2 000"
    typed = templates.typed_base(templates.base_text(F.col("t")))
    r = spark.createDataFrame([(text,)], "t string").select(templates.tokens(templates.template(typed)).alias("x"), templates.tokens(typed).alias("v")).first()
    assert r.x == "@ # @ ran # $ # iphone # $ @ s #".split() and len(r.v) == len(r.x) and r.v[2] == "Ana\x01Maria" and r.v[-1] == "1,000\x012\x01000"


LONG = "Bob Stone has 3 apples and 5 pears in the small basket that stands by the old kitchen door, and Bob Stone eats 3 of them on Monday."


def found(spark, tmp_path, items, texts):
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = run(spark, tmp_path, docs, [(i, t) for i, t in enumerate(items)])
    return {r.doc_id: r.item_ids for r in got if r.contaminated}


def test_names_of_other_lengths_case_and_shifted_words(spark, tmp_path):
    texts = [
        f"so we go {LONG.replace('Bob Stone', 'Ann').replace('3', '1 200')} and on",  # one word for two, two digit groups for one
        f"so we go {LONG.lower()} and on",
        f"so we go {LONG.upper()} and on",
        f"so we go {LONG.replace('small', 'very small')} and on",  # a word put in
        f"so we go {LONG.replace('pears in the small', 'pears in the')} and on",  # a word left out
        f"so we go {LONG.replace('Bob Stone eats 3', 'Bob Stone eats 4')} and on",  # a value that no longer fits
        "so we go there and on to the old market by the river that runs behind the hill",
    ]
    assert found(spark, tmp_path, [LONG], texts) == dict.fromkeys([0, 1, 2, 3, 4], "0")


def test_short_items_and_items_of_few_words(spark, tmp_path):
    items = ["what colour is the clear sky", "name two rivers", "Paris 12 Rome 7 Oslo 9 Bonn 4 Kiev 8"]
    texts = ["now tell me what colour is the clear sky today", "what colour is a clear sky", "Name two rivers!", "please name two rivers", "See Lima 3 Cairo 5 Delhi 6 Tokyo 2 Seoul 1 end", "x Paris 12 Rome y"]
    assert found(spark, tmp_path, items, texts) == {0: "0", 2: "1", 4: "2"}


def test_one_word_changed_in_the_middle(spark, tmp_path):
    words = [f"word{chr(97 + i)}x" for i in range(20)]
    changed = " ".join([*words[:10], "other", *words[11:]])
    half = " ".join([*words[:10], *(f"else{chr(97 + i)}" for i in range(10))])
    assert found(spark, tmp_path, [" ".join(words)], [f"a b {changed} c", f"a b {half} c"]) == {0: "0"}


def test_a_word_changed_put_in_or_left_out_anywhere(spark, tmp_path):
    """Items of 19 words or more are met wherever the edit is."""
    words = [f"word{chr(97 + i)}x" for i in range(19)]
    edits = [[*words[:i], "other", *words[i + 1 :]] for i in range(19)] + [[*words[:i], "other", *words[i:]] for i in range(20)] + [[*words[:i], *words[i + 1 :]] for i in range(19)]
    assert found(spark, tmp_path, [" ".join(words)], [f"a b {' '.join(e)} c" for e in edits]) == dict.fromkeys(range(58), "0")


def test_clean(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = templates.clean(docs, items)
    assert left.columns == docs.columns and left.count() == len(DOCS) - 4
    clashing = docs.selectExpr("*", "1 as key", "2 as _k", "3 as tid", "4 as item_id", "5 as `t`")
    left = templates.clean(clashing, items)
    assert left.columns == clashing.columns and left.count() == len(DOCS) - 4
