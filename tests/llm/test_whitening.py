from fractions import Fraction
from math import floor, isfinite

import numpy as np

from quaverlake.llm.shared import table
from quaverlake.llm.whitening import fit, integers, op11_whitening, whiten


def brute(rows, components=4):
    """{row number: (n, deviation, [whitened], [explained])} with rational sums; rows are (id, vector) of one dimension."""
    part = {k: tuple(floor(256 * float(c)) for c in v) for k, (_, v) in enumerate(rows) if v and all(c is not None and isfinite(c) for c in v)}
    fitted = sorted(set(part.values()))
    n, d = len(fitted), len(fitted[0])
    total = [sum(x[i] for x in fitted) for i in range(d)]
    mean = [Fraction(s, n) for s in total]
    cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fitted) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    out = {}
    for k, x in part.items():
        z = np.array([float(x[i] - mean[i]) for i in range(d)])
        with np.errstate(all="ignore"):
            white = [abs(z @ u[:, -c]) / np.sqrt(e[-c]) for c in range(1, min(components, d) + 1)]
        out[k] = (n, sum((n * x[i] - total[i]) ** 2 for i in range(d)), white, [e[-c] / np.trace(cov) for c in range(1, min(components, d) + 1)])
    return out


def compare(got, rows):
    want = brute(rows)
    ids = [i for i, _ in rows]
    assert len(set(ids)) == len(ids)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == {ids[k] for k in want}
    for k, (n, deviation, white, explained) in want.items():
        mine = by[ids[k]]
        assert sorted(mine) == list(range(1, len(white) + 1))
        for c, r in mine.items():
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(abs(r.whitened) - white[c - 1]) < 1e-8 * (1 + white[c - 1])
            assert abs(r.explained - explained[c - 1]) < 1e-10 and r.identity_error < 1e-9


def test_table_against_rationals(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()]
    compare(op11_whitening(spark, d).collect(), rows)


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(10**6), 10**6, (300, 5)) + 10**12  # far from zero: products of raw values would cancel
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(3)
    got = fit(df).covariance
    mean = [Fraction(int(s), 300) for s in x.sum(0)]
    for i in range(5):
        for j in range(5):
            assert got[i, j] == float(sum((int(a[i]) - mean[i]) * (int(a[j]) - mean[j]) for a in x) / 300)


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # one vector, many rows, once in the fit list
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan")] * 3), (203, [float("inf"), 0.0, 0.0]), (204, []), (205, [-0.0, 0.0, 1e-9])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, component int, whitened string").repartition(5)
    compare(whiten(df).collect(), rows)
    assert whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    twice = whiten(df.union(df).union(df.limit(1).selectExpr("null", "array(0D, 1D, 2D)", "1", "''"))).collect()
    assert len(twice) == 3 * (2 * 101 + 1) and sum(r.vec_id is None for r in twice) == 3
    assert len(whiten(df.union(spark.createDataFrame([(9, [1.0, 2.0], 0, "")], df.schema))).where("vec_id = 9 and size(array(1)) = 1").collect()) == 3  # another dimension takes no part
    assert whiten(df.limit(0)).collect() == [] and integers(df, "vec_id", "embedding").count() == 101


def test_no_variance_and_large_entries(spark):
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in flat] == [False, True, False, True] and flat[0].explained > 0.999 and flat[0].deviation == 2 * 256**2
    wide = whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5e9, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(wide) == 6 and {r.deviation for r in wide if r.vec_id < 3} == {None}


def test_sums_beyond_64_bits(spark):
    rows = [(i, [float(i * 10**9), float((i * 7 % 11) * 10**8)]) for i in range(50)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    want = brute(rows)
    assert {(r.vec_id, r.deviation) for r in got} == {(rows[k][0], v[1] if v[1] < 2**63 else None) for k, v in want.items()}
    for r in got:
        assert abs(abs(r.whitened) - want[r.vec_id][2][r.component - 1]) < 1e-8
