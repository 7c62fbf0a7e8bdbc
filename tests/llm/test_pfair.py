import math
from collections import defaultdict

import duckdb
import pytest

from quaverlake.llm import pfair
from quaverlake.llm.pfair import OP9_SQL, interleave, op9_pfair, quotas, schedule


def edf(q, period):
    """Straight from the definition."""
    had, line = [0] * len(q), []
    for t in range(period):
        due = [(math.ceil((h + 1) * period / x), i) for i, (h, x) in enumerate(zip(had, q)) if h * period // x <= t]
        i = min(due)[1]
        had[i] += 1
        line.append(i)
    return line


@pytest.mark.parametrize("totals,period", [([5, 1], 7), ([1000, 10, 10, 1], 50), ([1] * 12, 100), ([3], 5)])
def test_schedule_meets_windows(spark, totals, period):
    counts = spark.createDataFrame([(f"s{i:02}", t) for i, t in enumerate(totals)], "source string, total long")
    shares = quotas(counts, period)
    q = [r.quota for r in shares.orderBy("source").collect()]
    assert sum(q) == period and min(q) >= 1
    rows = schedule(shares, period).orderBy("source").collect()
    line = edf(q, period)
    assert [r.slots for r in rows] == [[t for t, i in enumerate(line) if i == k] for k in range(len(q))]
    for r in rows:
        for j, t in enumerate(r.slots):
            assert j * period // r.quota <= t < math.ceil((j + 1) * period / r.quota)


def test_interleave_deviation_and_completeness(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, "t") for i in range(3000)] + [(None, "c", "x"), (None, "c", "y"), (5, "c", "z"), (5, "c", "z")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, source string, text string, slot string")
    out = interleave(df, block_rows=4, period=100, weights={"a": 50.0, "b": 10.0}).collect()
    assert sorted([(r.doc_id, r.source, r.text) for r in out], key=str) == sorted(rows, key=str)
    assert len({(r.slot, r.place) for r in out}) == len(out)
    blocks = defaultdict(set)
    for r in out:
        blocks[r.source].add((r.block, r.slot))
    weight = {s: sum(1 for _, slot in b if slot < 100) for s, b in blocks.items()}  # a full period
    for s in ("a", "b"):
        had = sorted(slot for _, slot in blocks[s])
        for t in range(1, max(had)):
            assert abs(sum(x < t for x in had) - weight[s] / 100 * t) < 1


def test_same_result_for_any_partitioning_and_empty(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(500)], "doc_id long, source string")
    a, b = (sorted(map(tuple, interleave(df.repartition(n)).collect())) for n in (1, 9))
    assert a == b
    assert interleave(df.limit(0)).collect() == []


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cur = con.execute(OP9_SQL)
    names = [c[0] for c in cur.description]
    got = op9_pfair(spark, d)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(cur.fetchall())


def test_columns_of_any_name_and_a_long_period(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 3}", "x" * (i % 2 * 100_000)) for i in range(200)], "doc_id long, source string, text string")
    more = df.selectExpr("*", *[f"1 AS {n}" for n in ("quota", "slots", "_number", "_before", "_range", "range", "hash", "number", "before", "row", "rows")])
    plain, odd = interleave(df), interleave(more)
    assert odd.columns == [*more.columns, "block", "slot", "place"] and odd.where("quota = 1 and row = 1 and hash = 1").count() == 200
    key = lambda d: sorted((r.doc_id, r.block, r.slot, r.place) for r in d.collect())
    want = key(plain)
    assert key(odd) == want
    monkeypatch.setattr(pfair, "MOST_BROADCAST", 10)
    assert key(interleave(df)) == want
