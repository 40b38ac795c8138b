"""Samples of any total, many languages, and the ridge fit against plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from llm import language, quality
from llm.tables import sampled


def test_a_sample_of_any_total(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert sampled(rows, 200_000, 200_000).count() == 200_000
    assert 18_000 < sampled(rows, 200_000, 20_000).count() < 22_000
    # The share of a table of 1e11 or 1e18 rows is small, not none.
    for total in (10**11, 10**18):
        condition = sampled(rows, total, 20_000)._jdf.queryExecution().optimizedPlan().toString()
        share = (20_000 << 62) // total
        assert share > 0 and str(share) in condition


def test_three_hundred_languages():
    """Labels beyond 255 keep their numbers."""
    random = np.random.default_rng(1)
    scores = random.normal(size=(60, 300)).astype(np.float32)
    first = np.array([0, 25, 25, 60])
    got = language.viterbi(scores, first, 1.5)
    for a, b in zip(first, first[1:]):
        best, back = np.zeros(300), []
        for t in range(a, b):
            other = best.max() - 1.5
            back.append(np.where(other > best, best.argmax(), np.arange(300)))
            best = np.maximum(best, other) + scores[t]
        path, now = [], best.argmax()
        for t in range(b - a - 1, -1, -1):
            path.append(now)
            now = back[t][now]
        total = lambda p: scores[np.arange(a, b), p].sum() - 1.5 * np.count_nonzero(np.diff(p))
        if b > a:
            assert np.isclose(total(got[a:b].astype(int)), total(np.array(path[::-1])), atol=1e-3)
    assert got.max() > 255


def test_fit_equals_plain_numpy(spark):
    """Moments, normal equations, isotonic levels and scores over several partitions."""
    random = np.random.default_rng(2)
    values = random.normal(size=(600, quality.STATISTICS)).astype(np.float32)
    label = (values[:, 0] + 0.3 * random.normal(size=600) > 0).astype(int)
    rows = [(i, values[i].tolist(), int(label[i])) for i in range(600)] + [(600, values[0].tolist(), None)]
    table = spark.createDataFrame(rows, "doc_id bigint, statistics array<float>, label int").repartition(5)
    model = quality.fit(table)
    held = {r.doc_id for r in table.where(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0).select("doc_id").collect()}
    x, y = values.astype(np.float64), label.astype(np.float64)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    train = np.array([i for i in range(600) if i not in held])
    z = quality.fourier((x - x.mean(axis=0)) / x.std(axis=0))
    system = z[train].T @ z[train] + quality.RIDGE * len(train) * np.diag([1.0] * (quality.FEATURES - 1) + [1e-6])
    assert np.allclose(model.weights, np.linalg.solve(system, z[train].T @ y[train]), atol=1e-6)
    assert (np.diff(model.levels) >= -1e-12).all()
    scores = {r.doc_id: r.score for r in quality.scored(table, model).collect()}
    assert np.allclose([scores[i] for i in range(600)], model.score(x), atol=1e-9)
    assert np.mean((model.score(x) >= 0.5) == label) > 0.8
