import zlib

import numpy as np
import pytest

from guardlake.llm import quality
from guardlake.llm.common import table
from guardlake.session import settled


@pytest.fixture(scope="module")
def fitted(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    stats = settled(quality.statistics(docs), "statistics")
    return docs, labels, stats, quality.fit(stats, labels)


def test_held_out_accuracy(fitted):
    docs, labels, stats, model = fitted
    rows = quality.scored(stats, model).join(labels, stats["id"] == labels["doc_id"]).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 40 and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.GOOD) for r in rows)
    right = sum(r.predicted == r.quality for r in held) / len(held)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert right >= 0.95 and auc >= 0.97


def test_held_out_labels_are_not_used(fitted, spark):
    docs, labels, stats, model = fitted
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality"
    )
    again = quality.fit(stats, flipped)
    x = np.array([r.stats for r in stats.limit(50).collect()])
    assert np.allclose(model.score(x), again.score(x), atol=1e-6)


def test_normal_equations_match_one_fit_in_memory(fitted):
    _, labels, stats, model = fitted
    known = labels.where("quality is not null").where(~quality.held_out(labels["doc_id"]))
    rows = stats.join(known, stats["id"] == known["doc_id"]).select("stats", "quality").collect()
    x, y = np.array([r.stats for r in rows]), np.array([r.quality for r in rows], dtype=float)
    assert np.allclose(x.mean(axis=0), model.mean)
    z = quality.features(x, model.mean, model.scale, model.frequencies, model.phases)
    best = []
    for ridge in quality.RIDGES:
        penalty = np.eye(z.shape[1]) * ridge * len(z) / quality.FEATURES
        penalty[0, 0] = 1e-9
        best.append(np.abs(np.linalg.solve(z.T @ z + penalty, z.T @ y) - model.weights).max())
    assert min(best) < 1e-5


def test_awkward_rows_and_empty_tables(awkward, nothing, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    stats = settled(quality.statistics(awkward), "statistics")
    rows = quality.scored(stats, quality.fit(stats, labels)).collect()
    assert len(rows) == awkward.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    empty = settled(quality.statistics(nothing), "statistics")
    assert quality.scored(empty, quality.fit(empty, labels)).count() == 0
    unknown = quality.scored(stats, quality.fit(stats, labels.limit(0))).collect()
    assert {r.score for r in unknown} == {0.5}


def test_isotonic_levels_rise():
    rng = np.random.default_rng(0)
    s = np.sort(rng.uniform(size=500))
    y = (rng.uniform(size=500) < s).astype(float)
    knots, levels = quality.rising(s, y, np.ones(500))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    fit = np.interp(s, knots, levels)
    assert abs(fit.mean() - y.mean()) < 0.03 and ((fit - s) ** 2).mean() < 0.01
