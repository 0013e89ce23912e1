import math

import numpy as np
from pyspark.sql import functions as F

from guardlake.llm import vantage


def plain(vectors, k, by=50):
    """Cosines of all pairs, summed exactly."""
    usable = [
        (i, v) for i, v in vectors
        if i is not None and v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for i, v in usable:
        if i % by == 0:
            asked[i] = min(asked.get(i, v), v)
    out = {}
    for q, a in asked.items():
        scores = [
            (-math.fsum(x * y for x, y in zip(a, v)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in v)), i)
            for i, v in usable if i != q and len(v) == len(a)
        ]
        scores = sorted((round(s, 9), i) for s, i in scores)[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


def found(spark, vectors, k=5, **options):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    frame = frame.selectExpr("*", "1 AS id", "2 AS v", "3 AS cell", "4 AS rank", "5 AS score")
    rows = vantage.usable(frame, "vec_id", "embedding")
    out = {}
    for q, rank, i, score in vantage.nearest(rows.where(F.col("id") % 50 == 0), rows, k, **options).collect():
        out.setdefault(q, []).append((rank, i, round(score, 9)))
    return {q: sorted(rows) for q, rows in out.items()}


def rows_of(rng, n=600, width=8):
    """Clusters, copies of one vector in a third of the rows, scaled copies, and rows that take no part."""
    centres = rng.standard_normal((6, width)) * 3
    vectors = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(width)]) for i in range(n)]
    for i in range(0, n, 3):
        vectors[i] = (i, vectors[0][1])
    vectors[4] = (4, [2 * x for x in vectors[0][1]])
    vectors[5], vectors[7], vectors[8] = (5, None), (7, [1.0, None] * 4), (8, [float("nan")] * 8)
    vectors[10], vectors[11], vectors[100] = (10, [float("inf")] * 8), (11, [0.0] * 8), (100, [1e200] * 8)
    vectors[13], vectors[14], vectors[50] = (13, [1.0, 2.0]), (14, []), (50, [3.0, -1.0])
    return vectors + [(None, vectors[0][1]), vectors[20], vectors[20], (150, [1.0] * 8), (0, vectors[0][1])]


def test_stretch_one_matches_comparing_all(spark):
    vectors = rows_of(np.random.default_rng(1))
    small = [(i, v) for i, v in vectors if i != 100]
    for rows, options in ((small, dict(shard_rows=40, block_queries=3, sample_rows=300)), (small, {})):
        assert found(spark, rows, stretch=1.0, **options) == plain(rows, 5)


def test_large_components_stay_finite(spark):
    vectors = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200])]
    assert found(spark, vectors) == {0: [(1, 1, 1.0), (2, 2, 0.0)]}


def test_recall_of_the_default(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.standard_normal(64)]) for i in range(3000)]
    got, want = found(spark, vectors, shard_rows=500), plain(vectors, 5)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)


def test_no_rows(spark):
    assert found(spark, []) == {} and found(spark, [(0, [1.0])]) == {} and found(spark, [(1, [1.0]), (2, [2.0])]) == {}


def test_subtrees_are_left_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.standard_normal((200, 16)) * 0.05 for c in rng.standard_normal((20, 16))])
    tree = vantage.Tree(x / vantage.lengths(x)[:, None], 32)
    scored = {}
    for stretch in (1.0, 4.0):
        best = vantage.Nearest(5, np.full(20, -2.0))
        scored[stretch] = vantage.search_tree(tree, x, np.arange(len(x)), x[::200], np.arange(0, 4000, 200), best, stretch)
    assert scored[4.0] <= scored[1.0] < 0.2 * 20 * len(x)
