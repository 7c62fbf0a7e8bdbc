import random
import re

import numpy as np

from quaverlake.llm.minhash import UNIVERSE, _permutations, near_duplicates, op4_circulant_minhash, signature
from quaverlake.llm.shared import components, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORD.findall(low)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows):
    """{id: (sizes, component)} by all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    done = set()
    for ks in by.values():
        for m, p in enumerate(ks):
            for q in ks[m + 1 :]:
                if (p, q) in done:
                    continue
                done.add((p, q))
                (a, s), (b, t) = sets[p], sets[q]
                if a is not None and b is not None and 100 * len(s & t) >= 75 * len(s | t):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_shifted_permutation_makes_all_coordinates():
    sigma, _ = _permutations(128, 7)
    pi = np.random.default_rng(7)
    pi.permutation(UNIVERSE)
    pi = pi.permutation(UNIVERSE)
    s = np.array([5, 99, 12345678901234567890], np.uint64)
    got = signature(s, 128, 7)
    for k in (0, 1, 127):
        assert got[k] == min(pi[(sigma[int(x) % UNIVERSE] + k) % UNIVERSE] for x in s)


def test_chains_repeats_nulls(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["É", "Straße"]
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=rng.choice([1, 3, 5, 40, 120]))
        for _ in range(rng.choice([1, 2, 9])):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocab)
    rows += [(500, rows[-1][1].upper().replace("É", "É")), (501, None), (502, ""), (503, " \n"), (None, rows[0][1]), (None, None), (3, rows[20][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_shared_passage_below_the_threshold_and_open_buckets(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{rng.random()}" for _ in range(rng.choice([10, 16, 22, 40]))])) for i in range(60)]
    rows += [(100 + i, t + " tail") for i, t in rows[:10]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(near_duplicates(df)) == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, id int, n int, hub int, key string, component long")
    assert near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "a", 9, 9, 9, "k", 4), (2, "A", 9, 9, 9, "k", 5)], df.schema)
    assert result(near_duplicates(df)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 90)] + [(200, 201), (201, 201), (None, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 91)}, 201: 200}


def test_query_on_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    got = result(op4_circulant_minhash(spark, d))
    assert got == brute(rows) and any(not r[3] for r in got)


def test_small_edge_lists_take_one_file_and_stars_one_step(spark, monkeypatch):
    from pathlib import Path

    from quaverlake.llm import shared

    monkeypatch.setattr(shared, "cut", lambda df, plain=shared.cut: steps.append(1) or plain(df))
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for star, most in ((True, 2), (False, 20)):
            steps: list[int] = []
            edges = spark.createDataFrame([(i, 0 if star else i - 1) for i in range(1, 300)], "a long, b long")
            out = components(edges)
            files = [*Path(out._cut_at.removeprefix("file:")).rglob("*.parquet")]
            assert len(files) == 1 and len(steps) <= most
            assert sorted(tuple(r) for r in out.collect()) == [(i, 0) for i in range(1, 300)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
