import math

import numpy as np
from pyspark.sql import functions as F

from guardlake.llm import search


def plain(vectors, k):
    out = []
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    for q in sorted(i for i in whole if i % 100 == 0):
        scores = sorted(
            (-sum(a * b for a, b in zip(whole[q][0], v)), i)
            for i, own in whole.items() if i != q for v in own if len(v) == len(whole[q][0])
        )
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return out


def rows_of(spark, rng):
    vectors = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(700)]
    for i in range(0, 700, 3):
        vectors[i] = (i, vectors[0][1])
    vectors[5], vectors[6], vectors[7] = (5, None), (6, [1.0, None] * 4), (7, [float("nan")] * 8)
    vectors[8], vectors[9], vectors[100] = (8, [float("inf")] * 8), (9, [1.0, 2.0]), (100, [0.0] * 8)
    return vectors + [(None, vectors[0][1])]


def test_top_k_matches_comparing_all(spark):
    vectors = rows_of(spark, np.random.default_rng(2))
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    frame = frame.selectExpr("*", "1 AS id", "2 AS v", "3 AS shard", "4 AS kth", "5 AS rank", "6 AS block")
    whole = search.whole_vectors(frame, "vec_id", "embedding")
    asked = whole.where(search.divisible(F.col("id")))
    for shard_rows, block in ((90, 3), (10_000, 100)):
        got = search.top_k(asked, whole, 10, shard_rows, block).collect()
        assert sorted(map(tuple, got)) == sorted(plain(vectors, 10))


def test_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    whole = search.whole_vectors(frame, "vec_id", "embedding")
    got = search.top_k(whole.where("id = 0"), whole)
    assert list(map(tuple, got.collect())) == [(0, 1, 1, 1024 * 2048)]
    none = whole.limit(0)
    assert search.top_k(none, whole).count() == 0 and search.top_k(whole, none).count() == 0


def test_trees_are_read_as_they_were_built():
    x = np.floor(np.random.default_rng(1).standard_normal((500, 5)) * 1024)
    tree = search.BallTree(x, 20)
    back = search.BallTree.read(tree.stored(), 5)
    assert all(np.array_equal(getattr(tree, n), getattr(back, n)) for n in ("order", "centre", "radius"))
    assert [tuple(r) for r in back.range] == tree.range and [list(c) for c in back.child] == tree.child


def test_nodes_are_left_unvisited():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16)) * 4000
    x = np.floor(np.concatenate([c + rng.standard_normal((200, 16)) * 50 for c in centres]))
    tree = search.BallTree(x, 32)
    seen = []
    best = search.Best.offer
    try:
        search.Best.offer = lambda self, who, scores, ids, own: (seen.append(scores.size), best(self, who, scores, ids, own))
        search.branch_and_bound(x, np.arange(len(x)), tree, x[:5], np.arange(5), np.full(5, -np.inf), 10, False)
    finally:
        search.Best.offer = best
    assert sum(seen) < 0.5 * 5 * len(x)
