import numpy as np

from quaverlake.llm.rp_forest import augmented, grow, nearest, op8_rp_forest
from quaverlake.llm.shared import table


def brute(rows, k=20):
    """{query: [(rank, id, score)]} over rows (id, vector) as the operator defines them."""
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and ok(v)})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for n in np.flatnonzero(ids % 20 == 0):
        s = (x[n] * x).sum(1)
        at = [m for m in np.lexsort((ids, -s)) if ids[m] != ids[n]][:k]
        out[int(ids[n])] = [(r + 1, int(ids[m]), s[m]) for r, m in enumerate(at)]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_on_table(spark):
    d = "/root/testdata/sf0.01"
    want = brute([(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()])
    got = result(op8_rp_forest(spark, d))
    assert got.keys() == want.keys()
    hits = [len({i for _, i, _ in want[q]} & {i for _, i, _ in got[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.93
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and len({i for _, i, _ in rows}) == 20 and q not in {i for _, i, _ in rows}
        assert [s for _, _, s in rows] == sorted((s for _, _, s in rows), reverse=True)
        true = dict((i, s) for _, i, s in want[q])
        assert all(abs(s - true[i]) < 1e-12 for _, i, s in rows if i in true)


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.choice([0.1, 3])]) for i in range(200)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(101)]  # one vector, many ids
    rows += [(500, None), (520, [0.0] * 4), (540, [1.0, None, 2.0, 3.0]), (560, [float("nan")] + [1.0] * 3), (580, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (20, rows[20][1]), (600, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, rep int").repartition(4)
    got = result(nearest(df, lambda i: i % 20 == 0, sample=50, leaf=8, search=50, probes=50, group=64))
    want = brute([r for r in rows if r[0] != 600])
    assert got.keys() == want.keys()
    for q in want:
        assert [(r, i) for r, i, _ in got[q]] == [(r, i) for r, i, _ in want[q]], q
        assert np.allclose([s for *_, s in got[q]], [s for *_, s in want[q]], rtol=1e-12)
    dealt = result(nearest(df, lambda i: i % 20 == 0, sample=50, leaf=8, search=50, probes=50, group=3))  # points and queries in groups of three
    assert dealt == got
    assert nearest(df.limit(0), lambda i: i % 20 == 0).collect() == []
    few = df.where("vec_id in (20, 40)")
    assert sorted((r.query_id, r.vec_id) for r in nearest(few, lambda i: i % 20 == 0).collect()) == [(20, 40), (40, 20)]
    assert nearest(df.where("vec_id = 40"), lambda i: i % 20 == 0).collect() == []


def test_recall_where_the_search_prunes(spark):
    """Ten thousand vectors with structure: a search over a quarter of them finds more than nine in ten of the nearest."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 24)) * 2
    x = centres[rng.integers(0, 60, 10_000)] + rng.normal(size=(10_000, 24)) * 0.6
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = result(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), lambda i: i % 20 == 0, sample=4000, leaf=64, search=1000, probes=8))
    want = brute(rows)
    assert got.keys() == want.keys() and np.mean([len({i for _, i, _ in want[q]} & {i for _, i, _ in got[q]}) / 20 for q in want]) >= 0.9


def test_augmented_angles_follow_inner_products():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    q = np.append(rng.normal(size=3), 0)
    a = augmented(x, (x**2).sum(1).max())
    assert np.allclose((a**2).sum(1), (a**2).sum(1)[0]) and (np.argsort(a @ q) == np.argsort(x @ q[:3])).all()
    f = grow(x, (x**2).sum(1).max(), trees=3, leaf=4)
    assert np.bincount(f.lead(a).ravel(), minlength=f.leaves).min() >= 1
