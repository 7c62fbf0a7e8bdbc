import hashlib
import random
import re

import pytest

from quaverlake.llm.substring_dedup import op5_substring_dedup, remove_repeats
from quaverlake.llm.shared import table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """(n_words, n_removed, kept text) of each row, straight from the definition."""
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    key = lambda i: (i is None, i or 0)
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - size + 1):
            s = tuple(w[k : k + size])
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("size,chunk", [(3, 200), (13, 4 << 20), (1, 1 << 20)])
def test_against_brute_force(spark, size, chunk):
    rng = random.Random(size)
    vocab = ["a", "be", "ça", "x" * 40, "日本", "!"]
    rows = [(i, rng.choice([" ", "\t\n", "  "]).join(rng.choices(vocab, k=rng.choice([0, 1, 5, 30, 60])))) for i in range(60)]
    rows += [(60, rows[3][1]), (60, rows[3][1]), (None, rows[5][1]), (None, rows[7][1]), (61, None), (62, ""), (63, " \n"), (64, "word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, window=size, chunk_bytes=chunk, bucket_windows=50).collect()]
    assert order(got) == order(brute(rows, size))


def test_intervals_are_maximal(spark):
    rows = [(1, "p q a b c d e f z"), (2, "a b c d e f y a b c")]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=3).collect()}
    assert got[2].spans == [[0, 6], [7, 10]] and got[2].kept == "y" and got[1].spans == []


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, chunk int, bits string, id int")
    assert remove_repeats(empty).collect() == []
    one = spark.createDataFrame([(1, "a b", 5, "x", 3)], empty.schema)
    assert remove_repeats(one).first().kept == "a b"


def test_query_on_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, 13)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5_substring_dedup(spark, d).collect()}
    assert got == want and any(k for _, k, _ in want.values())
