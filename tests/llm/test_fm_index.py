import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quaverlake.llm.fm_index import OP12_SQL, Block, Index, build_index, decontaminate, merged, op12_fm_index, phrases, search, suffixes
from quaverlake.llm.shared import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    """[(id, n_words, n_hit, spans, item ids)] by comparing every window of every document with every phrase."""
    known = {}
    for i, text in items:
        w = words(text)
        for k in range(max(0, len(w) - window) + 1 if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, text in docs:
        w, dead, found = words(text), set(), set()
        for m in {len(p) for p in known}:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k : k + m])) in known:
                    dead |= set(range(k, k + m))
                    found |= {str(x) for x in known[p] if x is not None}
        edge = sorted(dead)
        begins, ends = [a for a in edge if a - 1 not in dead], [a + 1 for a in edge if a + 1 not in dead]
        out.append((i, len(w), len(dead), list(zip(begins, ends, strict=True)), sorted(found)))
    return out


def rows(df):
    return [(r[0], r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r["items"])) for r in df.collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffixes_of_random_texts():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 80))
        codes, ends = rng.integers(1, 4, n), rng.random(n) < 0.1
        ends[-1] = True
        codes[ends] = 0
        key = lambda i: [(0, j) if ends[j] else (1, int(codes[j])) for j in range(i, n)]  # noqa: E731, B023
        assert list(suffixes(codes, ends)) == sorted(range(n), key=key)


def test_backward_search_and_locate():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, sigma = int(rng.integers(2, 400)), int(rng.integers(2, 12))
        codes, ends = rng.integers(1, sigma, n), rng.random(n) < 0.05
        ends[-1] = True
        codes[ends] = 0
        index = Index(**Index.build(codes, ends, sigma))
        lengths = rng.integers(1, 6, 60)
        asked = np.zeros((60, 5), np.int64)
        for row, m in enumerate(lengths):
            asked[row, 5 - m :] = rng.integers(1, sigma, m)
        got = {}
        for p, low, high in zip(*index.find(asked, lengths), strict=True):
            got[int(p)] = sorted(index.locate(np.arange(low, high)).tolist())
        for row, m in enumerate(lengths):
            want = [k for k in range(n - m + 1) if (codes[k : k + m] == asked[row, 5 - m :]).all()]
            assert got.get(row, []) == want


def test_spans_merge():
    g, b, e = merged(np.array([1, 0, 1, 1, 2]), np.array([5, 3, 0, 4, 1]), np.array([9, 4, 4, 7, 2]))
    assert list(zip(g, b, e, strict=True)) == [(0, 3, 4), (1, 0, 9), (2, 1, 2)]
    assert [len(x) for x in merged(*[np.zeros(0, np.int64)] * 3)] == [0, 0, 0]


def test_table_against_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, d, "benchmark").collect()]
    want = sorted((i, n, h, len(t), hashlib.sha256(",".join(t).encode()).hexdigest(), h > 0) for i, n, h, _, t in brute(docs, items))
    got = sorted(tuple(r) for r in op12_fm_index(spark, d).collect())
    assert got == want and sum(r[5] for r in got) > 0
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert sorted(con.execute(OP12_SQL).fetchall()) == want


@pytest.mark.parametrize(("shard_words", "block_phrases"), [(1 << 20, 200_000), (40, 7), (64, 3)])
def test_small_shards_and_blocks(spark, shard_words, block_phrases):
    rng = np.random.default_rng(shard_words)
    text = lambda n: " ".join(rng.choice(["ab", "cd", "É", "7", "x-y", "Zz.", "ss"], n))
    docs = [(i, text(rng.integers(0, 300))) for i in range(25)] + [(7, "ab cd"), (None, "cd 7 ab É"), (30, None), (31, ""), (32, " -- \n"), (33, "AB  cd\tÉ")] * 2
    items = [(i, text(rng.integers(0, 9))) for i in range(12)] + [(3, "É é"), (None, "cd 7"), (50, None), (51, "..."), (52, "ab cd"), (52, "ab cd"), (53, "AB-CD")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, key long, items string").repartition(3)
    it = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    got = rows(decontaminate(df, it, window=5, shard_words=shard_words, block_phrases=block_phrases))
    same(got, brute(docs, items, 5))


def test_long_text_goes_through_several_shards(spark):
    rng = np.random.default_rng(5)
    w = [f"w{k}" for k in rng.integers(0, 40, 30_000)]
    items = [(k, " ".join(w[at : at + 14])) for k, at in enumerate((0, 991, 1010, 15_000, 29_986))] + [(9, "w1 w2 w3")]
    docs = [(1, " ".join(w)), (2, " ".join(w[:500])), (3, "é" * 3_000_000 + " " + " ".join(w[985:1030]))]
    got = rows(decontaminate(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), shard_words=1000))
    same(got, brute(docs, items))


def test_empty_tables_and_index_used_twice(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "q")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    same(rows(decontaminate(docs, none)), [(1, 11, 0, [], []), (2, 1, 0, [], [])])
    assert decontaminate(docs.limit(0), none).collect() == []
    index = build_index(docs).cache()
    for text, hits in (("b c d e f g h i j k", 1), ("b c d e f g h i j", 1), ("c b", 0), ("q", 1)):
        assert search(index, phrases(spark.createDataFrame([(5, text)], "item_id long, text string"))).count() == hits
    with pytest.raises(ValueError, match="shards"):
        build_index(docs, shard_words=1 << 21)


def test_block_keeps_phrases_of_several_items_once():
    block = Block.of(pa.table({"item": ["1", "2", None], "words": [["a", "b"], ["a", "b"], ["b"]]}))
    assert len(block.codes) == 2 and sorted(np.diff(block.bounds)) == [1, 2] and block.names == ["1", "2"]
