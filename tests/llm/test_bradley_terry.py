import zlib

import numpy as np
import pytest

from quaverlake.llm.bradley_terry import FEATURES, accepted, features, fit, fit_pairs, op3_bradley_terry, score
from quaverlake.llm.shared import table


def test_pairs_recover_a_ranking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    w = np.array([2.0, -1.0, 0.5, 0.0, 3.0])
    y = (x @ w + rng.logistic(size=2000) > 1).astype(int)
    m = fit_pairs(x, y)
    assert np.corrcoef(x @ m.weights, x @ w)[0, 1] > 0.98
    assert abs(((x @ m.weights) > m.threshold).mean() - y.mean()) < 0.01  # the quantile


def test_features_do_not_depend_on_neighbours():
    texts = ["", "Ab! cD\n", "", "x" * 10 + "!!", "é ** é"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    together = features(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, d in enumerate(data):
        assert np.allclose(together[k], features(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0]), texts[k]
    assert together.shape == (5, FEATURES) and not together[0].any()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    d = f"/root/testdata/{sf}"
    got = op3_bradley_terry(spark, d)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == table(spark, d, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    truth = [(r.quality, rows[r.doc_id].predicted) for r in table(spark, d, "labels").collect() if rows[r.doc_id].held_out]
    recall = [np.mean([p == y for t, p in truth if t == y]) for y in (0, 1)]
    print(recall)
    assert min(recall) > 0.97


def test_nulls_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 7.0), (None, "a b c", 8.0), (2, "", 9.0), (2, "", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = fit(docs, labels)
    assert [r.score for r in score(docs, model).collect()] == [0.5] * 4
    assert accepted(docs, model).count() == 4 and accepted(docs, model).columns == docs.columns
    assert fit(docs.limit(0), labels.limit(0)).threshold == 0
    assert score(docs.limit(0), model).collect() == []
