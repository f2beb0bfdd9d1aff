import hashlib
import random
import re

import numpy as np
import pytest
from helpers import ODD_ROWS, write
from hypothesis import given, settings
from hypothesis import strategies as st

from townsheet.llm import fim, queries

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), sha("<S>" + s + "<P>" + p + "<M>" + m), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha("<P>" + p + "<S>" + s + "<M>" + m), sha(text)


def rows():
    rnd = random.Random(2)
    parts = ["word", "a", " ", "\n", "é", "日本", "\U0001f600", "<", "P>", "<S", "12", "Zz", "[", "{", "@", "`", "\x00"]
    out = [(i - 5, "".join(rnd.choice(parts) for _ in range(rnd.randrange(60))), "en", "s", 0) for i in range(300)]
    marked = [(1000 + i, f"a {m} b", "en", "s", 0) for i, m in enumerate(("<P>", "<S>", "<M>", "<P", "<<P>>"))]
    return out + marked + ODD_ROWS


def test_like_brute_force(spark, tmp_path):
    some = rows()
    got = queries.op12_fill_in_middle(spark, write(spark, some, tmp_path, extra=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(r[0], r[1]) for r in some), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert queries.op12_fill_in_middle(spark, write(spark, [], tmp_path)).count() == 0


def test_texts_come_back(spark, tmp_path):
    some = rows()
    docs = spark.read.parquet(write(spark, some, tmp_path) + "/documents.parquet")
    back = fim.restore(fim.transform(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in some), key=str)


def test_like_sql(spark):
    """The query's SQL over the smallest tables."""
    from compare import compare

    name = "op12_fill_in_middle"
    assert compare(spark, "/root/testdata/sf0.001", name, queries.queries()[name], queries.oracle_sql()[name]) == ""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abzAZ \n.é日"), st.characters(codec="utf-8")), max_size=400), st.integers(1, 126))
def test_every_cut_is_exact(text, error):
    index = fim.Index.of(text, error)
    at = np.cumsum([0, *map(len, TOKEN.findall(text))])
    assert len(index) == len(at) - 1
    assert [index.cut(k) for k in range(len(at))] == at.tolist()
    assert np.abs(at - index.predict(np.arange(len(at)))).max() <= error


@pytest.mark.parametrize("error,most", [(100, 40), (10, 4000)])
def test_long_texts_need_few_lines(error, most):
    rnd = random.Random(4)
    text = " ".join("x" * rnd.choice([1, 2, 3, 5, 8, 13]) for _ in range(50000)) + "y" * 100000 + " z" * 20000
    index = fim.Index.of(text, error)
    at = np.cumsum([0, *map(len, TOKEN.findall(text))])
    assert (index.predict(np.arange(len(at))) + index.residual == at).all()
    assert len(index.first) < most and np.abs(index.residual).max() <= error


def test_stored_indexes_answer_cuts(spark, tmp_path):
    some = rows()
    docs = spark.read.parquet(write(spark, some, tmp_path) + "/documents.parquet")
    text = {}
    for r in some:
        text.setdefault(r[0], []).append(r[1] or "")
    for r in fim.tables(docs, 20).collect():
        index = fim.Index(np.array(r.first, np.int64), np.array(r.offset, np.int64), np.array(r.slope), np.frombuffer(r.residual, np.int8))
        cuts = [index.cut(k) for k in range(len(index) + 1)]
        assert any(cuts == np.cumsum([0, *map(len, TOKEN.findall(t))]).tolist() for t in text[r.doc_id])
    with pytest.raises(ValueError):
        fim.Index.of("a", 127)
