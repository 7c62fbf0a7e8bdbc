import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from quaverlake.llm import perfect_hash
from quaverlake.llm.perfect_hash import Shards, build
from quaverlake.llm.shared import table
from quaverlake.llm.source_divergence import OP13_SQL, _recount, divergence, op13_divergence, shares

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, top=10):
    """Rows of the audit over (lang, source, text), with Python's integers."""
    docs = [tuple(x or "" for x in d) for d in docs]
    seen, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOWER))
        seen[lang].update(set(w))
        groups[lang, source].update(w)
    out = []
    for lang in {x[0] for x in docs}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        mine = {s: g for (la, s), g in groups.items() if la == lang}
        whole = sum(mine.values(), Counter())
        share = lambda g: {t: 1 + 10**9 * (g[t] + 2) // (sum(g[u] for u in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(g) for s, g in mine.items()}, share(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pair = [(-sum(far(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            term = [(-far(p[s][t], q[t]), t) for t in kept if mine[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def shard_rows(lang, terms, shards):
    terms = pa.array(terms, pa.large_string())
    of = perfect_hash.shard_of(terms, np.full(len(terms), shards))
    out = []
    for k in range(shards):
        if (of == k).any():
            sizes, bits, keys = build(terms.filter(pa.array(of == k)))
            out.append({"lang": lang, "shard": k, "shards": shards, "sizes": sizes, "bits": bits, "keys": keys.to_pylist()})
    return out


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(0)
    en, de = [f"e{k}" for k in range(3000)], [f"d{k}é" for k in range(50)] + ["e7"]
    s = Shards.of(shard_rows("de", de, 3) + shard_rows("en", en, 7))
    for lang, keys, low in (("de", de, 0), ("en", en, 51)):
        slots = s.slots(lang, pa.array(keys, pa.large_string()))
        assert sorted(slots) == list(range(low, low + len(keys)))
    other = [f"x{k}" for k in rng.integers(0, 10**6, 20_000)]
    assert (s.slots("en", pa.array(other, pa.large_string())) == -1).all() and (s.slots("fr", pa.array(["e1"], pa.large_string())) == -1).all()
    assert build(pa.array([], pa.large_string()))[0] == []
    # A shard that is not here answers nothing.
    part = Shards.of(shard_rows("en", en, 7)[2:4])
    got = part.slots("en", pa.array(en, pa.large_string()))
    assert sorted(got[got >= 0]) == list(range(part.first[-1])) and 0 < part.first[-1] < 3000


def test_keys_of_equal_hash(monkeypatch):
    """Where hashes cannot part keys, the list of the rest does."""
    monkeypatch.setattr(perfect_hash, "string_hashes", lambda a: np.array([len(x) for x in a.to_pylist()], np.uint64))
    s = Shards.of(shard_rows("en", ["a", "b", "ccc", "dd", "ee"], 1))
    got = s.slots("en", pa.array(["a", "b", "ccc", "dd", "ee", "z", "yy", "xxx"], pa.large_string()))
    assert sorted(got[:5]) == [0, 1, 2, 3, 4] and (got[5:] == -1).all()


def test_shares_are_exact():
    for count, total, terms in ((0, 0, 1), (7, 10, 2), (10**15, 9 * 10**15, 10**8), (9 * 10**15 - 9, 9 * 10**15 - 9, 3), (123456789, 10**12 + 7, 12345)):
        assert int(shares(np.array([count]), total, terms)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def test_table_against_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.01"
    want = brute([(r.lang, r.source, r.text) for r in table(spark, d, "documents").collect()])
    got = rows(op13_divergence(spark, d))
    assert got == want and len(got) > 1000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(con.execute(OP13_SQL).fetchall()) == want


def test_edges_in_small_shards_and_tiles(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["aa", "Bb", "É", "é", "c1d", "zz", "\U0001f600", "łódź", "q"]
    docs = [(f"l{k % 2}", f"s{rng.integers(0, 7)}", " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for k in range(120)]
    docs += [(None, "s1", "aa"), ("", None, "aa"), ("l0", None, None), ("l1", "only", ""), ("none", "a", "x1y"), ("none", "b", None), ("one", "s", "aa " * 50)]
    docs += [("l0", "copies", "aa zz q " * 300)] * 60
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "lang string, source string, text string, term int, item string").repartition(5)
    want = brute(docs, least=3)
    for setting in ({}, {"shard_terms": 2, "tile": 2, "cells": 9, "broadcast_bytes": 60}):
        assert rows(divergence(df, min_docs=3, **setting)) == want, setting
    assert rows(divergence(df, min_docs=3)) == rows(divergence(df.coalesce(1), min_docs=3))
    assert {r[4] for r in want if r[0] == "none"} == {0} and divergence(df.limit(0)).collect() == []
    assert rows(divergence(df, min_docs=1000)) == brute(docs, least=1000)


def test_very_long_text(spark):
    docs = [("en", "a", "ab " * 2_000_000 + "é" * 1_000_000), ("en", "b", "ab cd")]
    assert rows(divergence(spark.createDataFrame(docs, "lang string, source string, text string"), min_docs=1)) == brute(docs, 1)


def test_a_task_hands_on_a_count_once_though_groups_times_slots_exceed_its_cells():
    rng, words = random.Random(5), [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for lang in ("de", "en"):
        keys = pa.array(words[:80] if lang == "de" else words[20:], pa.large_string())
        shard = perfect_hash.shard_of(keys, np.full(len(keys), 3))
        for s in range(3):
            sizes, bits, own = perfect_hash.build(keys.filter(pa.array(shard == s)))
            rows.append({"lang": lang, "shard": s, "shards": 3, "sizes": sizes, "bits": bits, "keys": own.to_pylist()})
    terms = {(r["lang"], r["shard"], i): k for r in rows for i, k in enumerate(r["keys"])}
    kept = {(lang, k) for (lang, _, _), k in terms.items()}
    docs = [(rng.choice(["de", "en", "fr"]), f"s{rng.randrange(40)}", " ".join(rng.choices(words, k=3))) for _ in range(600)]
    want = Counter((lang, source, w) for lang, source, text in docs for w in text.split() if (lang, w) in kept)
    batches = pa.table(dict(zip(("lang", "source", "text"), map(list, zip(*docs, strict=True)), strict=True))).to_batches(100)
    for cells, once in ((2000, True), (50, False)):
        found = [(terms[b["lang"][i].as_py(), b["shard"][i].as_py(), b["slot"][i].as_py()], b["lang"][i].as_py(), b["source"][i].as_py(), b["n"][i].as_py()) for b in _recount(iter(batches), perfect_hash.Shards.of(rows), cells) for i in range(len(b))]
        got = Counter()
        for w, lang, source, n in found:
            got[lang, source, w] += n
        assert got == want
        assert (len(found) == len(want)) == once
