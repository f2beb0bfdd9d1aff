import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from helpers import ODD_ROWS, write
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from townsheet.llm import queries, repair

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def pairs_left(block):
    """How often each pair of adjacent symbols of one document occurs, left to right without overlap."""
    starts, counts = {*block.places.tolist()}, {}
    taken = {}
    for i, pair in enumerate(zip(block.symbols.tolist(), block.symbols.tolist()[1:])):
        if i + 1 not in starts and taken.get(pair) != i:
            counts[pair] = counts.get(pair, 0) + 1
            taken[pair] = i + 1
    return counts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=6), st.sampled_from([0, 70000]), st.sampled_from([2, repair.LEAST]))
def test_round_trip_until_no_pair_occurs_often(parts, shift, least):
    parts = [np.array(p, "<u4") + shift for p in parts]
    block = repair.Block(repair.pack([None, *range(1, len(parts))], parts, least))
    assert block.doc_ids == [None, *range(1, len(parts))]
    for i, (want, got) in enumerate(zip(parts, block.all_ids(), strict=True)):
        assert (want == got).all()
        a, b = len(want) // 3, len(want) - len(want) // 4
        assert (block.decode_range(i, a, b) == want[a:b]).all()
    assert (block.lengths >= 2).all() and (block.left < block.first + np.arange(len(block.left))).all()
    assert max(pairs_left(block).values(), default=0) < least


def test_more_symbols_than_sixteen_bits_hold():
    rnd = np.random.default_rng(3)
    parts = [rnd.permutation(60000).astype("<u4")] * 3 + [rnd.integers(0, 300, 40000).astype("<u4")]
    block = repair.Block(repair.pack([*range(4)], parts, 2))
    assert block.first + len(block.left) > 1 << 16 and all((a == b).all() for a, b in zip(parts, block.all_ids()))
    assert max(pairs_left(block).values()) < 2 and block.lengths.max() >= 50000


def test_repeats_shrink_and_rules_stay_within_documents():
    parts = [np.array([7, 8, 9] * 400 + [1], "<u4")] * 3
    block = repair.Block(repair.pack([1, 2, 3], parts))
    assert len(block.symbols) < 40 and len(block.left)
    ends = np.cumsum(block.size[block.symbols])
    assert set(np.cumsum(block.sizes)) <= set(ends)


def encoded(found, texts):
    ids, sizes = found.encode(pa.array(texts, pa.string()))
    return np.split(ids, np.cumsum(sizes)[:-1])


def test_encoder_like_library(monkeypatch):
    monkeypatch.setattr(repair, "CACHE", 10)
    monkeypatch.setattr(repair, "KEEP", 3)
    monkeypatch.setattr(repair, "JOINED", 4)
    found = repair.Encoder(PATH)
    texts = ["", None, "  ", "Don't stop, we'll GO", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "ΣΑΣ é  x\x1cy\x85z\xa0Q", "é ́ 中文", "x" * 3000]
    for _ in range(3):
        for t, ids in zip(texts, encoded(found, texts), strict=True):
            assert (ids == ids_of(t)[:-1]).all()
        assert len(found.rows) <= 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abTHé'sßœıİ,.1²½ªΣ-|<> \n\x85\u212a\u0301"), max_size=30), min_size=1, max_size=5))
def test_random_texts_like_library(texts):
    for t, ids in zip(texts, encoded(repair.encoder(PATH), texts), strict=True):
        assert (ids == ids_of(t)[:-1]).all()


def brute(rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(t)
        out.append((d, len(ids), zlib.crc32(ids.tobytes())))
    return out


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair.blocks, "__defaults__", (300, 1))
    monkeypatch.setattr(repair.write, "__defaults__", (300,))
    rows = [(i + 10, f"the word {i} and the other thing, again the thing " * (i % 9), "en", "s", 0) for i in range(80)] + ODD_ROWS
    got = queries.op1_repair_grammar(spark, write(spark, rows, tmp_path, extra=True)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got])) == sorted(map(str, brute([r[:2] for r in rows])))
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.r_[0, np.cumsum([r.n_tokens for r in by_start])[:-1]].tolist()
    ids = [r.doc_id for r in by_start]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert queries.op1_repair_grammar(spark, write(spark, [], tmp_path)).count() == 0


def test_files_written_until_no_pair_occurs_twice(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten " * (1 + i % 3) + str(i)) for i in range(40)], "doc_id long, text string")
    repair.write(docs, f"{tmp_path}/two", public_tokenizers.path(queries.TOKENIZER), least=2)
    repair.write(docs, f"{tmp_path}/four", public_tokenizers.path(queries.TOKENIZER))
    blocks = [repair.Block(r.payload) for r in spark.read.parquet(f"{tmp_path}/two").collect()]
    assert max((n for b in blocks for n in pairs_left(b).values()), default=0) < 2
    read = lambda name: sorted(map(tuple, repair.read(spark, f"{tmp_path}/{name}").collect()))
    assert read("two") == read("four") and len(read("two")) == 40
