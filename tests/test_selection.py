import numpy as np
from pyspark.sql import functions as F

from guardlake.operators import diverse, matching, scoring


def greedy(vectors, k, start):
    """Brute-force farthest-point selection."""
    x = np.asarray(vectors, dtype=float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(n == 0, 1, n)
    distance = np.round(np.clip(1 - x @ x.T, 0, 2), 12)
    picks = [start]
    while len(picks) < min(k, len(x)):
        rest = [i for i in range(len(x)) if i not in picks]
        best = max(rest, key=lambda i: (distance[i][picks].min(), -i))
        picks.append(best)
    return picks


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(vectors)], "id bigint, v array<float>")


def test_exact_selection_equals_brute_force_for_any_pool(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(120, 6)).astype(np.float32)
    vectors[50:60] = vectors[40]
    vectors[7] = 0
    df = frame(spark, vectors)
    want = greedy(vectors, 118, 3)
    for pool in (1, 10, 1024):
        k = 30 if pool == 1 else 118
        got = diverse.farthest_points(df, k, "id", "v", 3, pool).orderBy("pick_order").collect()
        assert [r.id for r in got] == want[:k]
        distances = [r.min_dist for r in got[1:]]
        assert distances == sorted(distances, reverse=True)


def test_passes_read_only_clusters_that_may_hold_the_farthest(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8))
    vectors = np.array([centres[i % 12] + rng.normal(size=8) * 0.02 * (1 + i % 12) for i in range(960)], dtype=np.float32)
    vectors[5], vectors[17] = 0, vectors[29]
    df = frame(spark, vectors).repartition(3)
    want = greedy(vectors, 60, 3)
    passes = []
    got = diverse.farthest_points(df, 60, "id", "v", 3, cluster_rows=80, read=passes.append).orderBy("pick_order").collect()
    assert [r.id for r in got] == want
    assert passes[0] == 960 and len(passes) > 1 and np.mean(passes[1:]) < 0.6 * 960
    assert [r.id for r in diverse.farthest_points(df, 60, "id", "v", 3).orderBy("pick_order").collect()] == want


def test_more_picks_than_rows(spark):
    df = frame(spark, np.eye(3))
    assert diverse.farthest_points(df, 10, "id", "v", 0).count() == 3


def test_core_set_radius_is_within_its_bound(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, rng.normal(size=(400, 5))).repartition(4)
    exact = diverse.farthest_points(df, 20, "id", "v", 0)
    near = diverse.farthest_points_coreset(df, 20, "id", "v", 0)
    small_parts = diverse.core_set(df, 20, "id", "v", part_rows=50)
    assert small_parts.count() == 8 * 20
    best = diverse.radius(df, exact, "id", "v").first().radius
    got = diverse.radius(df, near, "id", "v").first().radius
    # Chords of unit vectors are a metric, where a core-set of greedy picks reaches 4 times the optimum at most,
    # and the optimum is no larger than what plain greedy reaches.
    assert np.sqrt(2 * got) <= 4 * np.sqrt(2 * best)
    assert near.select("id").distinct().count() == 20


def test_core_set_does_not_depend_on_the_layout(spark):
    df = frame(spark, np.random.default_rng(8).normal(size=(300, 5)))
    kept = []
    for n in (1, 4, 16):
        laid = df.repartition(n)
        kept.append({r.id for r in diverse.core_set(laid, 10, "id", "v", part_rows=60).collect()})
        picks = diverse.farthest_points_coreset(laid, 15, "id", "v", 0, per_part=20).orderBy("pick_order").collect()
        kept.append([r.id for r in picks])
    assert kept[0::2] == [kept[0]] * 3 and kept[1::2] == [kept[1]] * 3


def test_many_picks_stay_exact_and_vectors_may_be_null(spark):
    x = np.random.default_rng(9).normal(size=(2_030, 3))
    df = frame(spark, x).unionByName(spark.createDataFrame([(9_000, None), (9_001, [1.0, None, 2.0])], "id bigint, v array<float>"))
    got = [r.id for r in diverse.farthest_points(df, 2_001, "id", "v", 3).orderBy("pick_order").collect()]
    assert len(set(got)) == 2_001 and not {9_000, 9_001} & set(got)
    assert got[:40] == greedy(x.astype(np.float32), 40, 3)
    assert diverse.radius(df, df.where("id < 3"), "id", "v", block=2).first().radius > 0


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "u array<double>, v array<double>")
    got = [round(r[0], 9) for r in df.select(diverse.cosine_distance(F.col("u"), F.col("v"))).collect()]
    assert got == [1.0, 0.0, 1.0]


def test_nearest_exemplar_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    words = ["a", "bb", "ccc", "it's", "d\\e", "ffff", "g", "hh"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(150)] + [(500, None), (501, "")]
    exemplars = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for i in range(12)] + [(99, "")]
    df = spark.createDataFrame(docs, "id bigint, t string")
    ex = spark.createDataFrame(exemplars, "e bigint, x string")
    for threshold in (0.3, 0.6, 1.0):
        want = {}
        for i, t in docs:
            scores = []
            for e, x in exemplars:
                s = set(x.split())
                n = len(s & set((t or "").split()))
                if s and n and n >= threshold * len(s) - 1e-9:
                    scores.append((n / len(s), -e))
            if scores:
                want[i] = (-max(scores)[1], max(scores)[0])
        got = matching.nearest_exemplar(df, "id", "t", ex, "e", "x", threshold).collect()
        assert {r.id: (r.e, r.score) for r in got} == want


def test_more_exemplar_tokens_than_once_fitted_a_plan(spark):
    ex = spark.range(7_000).selectExpr("concat('e', id) AS e", "concat_ws(' ', concat('a', id), concat('b', id), concat('c', id)) AS x")
    df = spark.createDataFrame([(1, "b5 a5 zz c5"), (2, "a6999 b6999"), (3, "a1 b2 c3"), (4, None)], "id bigint, t string")
    got = matching.nearest_exemplar(df, "id", "t", ex, "e", "x", 0.6).collect()
    assert {(r.id, r.e, round(r.score, 3)) for r in got} == {(1, "e5", 1.0), (2, "e6999", 0.667)}


def test_policy_rules(spark):
    df = spark.createDataFrame([(1, "the fight club"), (2, "Fight Club"), (3, None)], "id bigint, t string")
    rules = [matching.Rule("r1", "fight club", "Rule 1"), matching.Rule("r2", "^F", "Rule 2", regex=True)]
    got = matching.policy_hits(df, ["id"], "t", rules).collect()
    assert {tuple(r) for r in got} == {(1, "r1", "Rule 1"), (2, "r2", "Rule 2")}


def test_nearest_vector(spark):
    df = frame(spark, [[1, 0], [0, 1], [-1, 0]])
    ex = spark.createDataFrame([(7, [2.0, 0.1]), (8, [0.0, 5.0])], "e bigint, w array<double>")
    got = matching.nearest_vector(df, "id", "v", ex, "e", "w", 0.5).collect()
    assert {(r.id, r.e) for r in got} == {(0, 7), (1, 8)}
    named = spark.createDataFrame(
        [("x", [2.0, 0.1]), ("b", [0.0, 5.0]), ("a", [0.0, 1.0]), ("n", None), ("m", [None, 1.0])], "e string, w array<double>"
    )
    rows = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0]), ("r", None), ("s", [None, 1.0])], "id string, v array<float>")
    for block in (1, 2, 4096):
        got = matching.nearest_vector(rows, "id", "v", named, "e", "w", 0.5, block).collect()
        assert {(r.id, r.e) for r in got} == {("p", "x"), ("q", "a")}


def test_vector_join_meets_fewer_than_half_of_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 12))
    draw = lambda n: [[float(x) for x in centres[i % 30] + rng.standard_normal(12) * 0.05] for i in range(n)]
    rows, known = draw(900), draw(240)
    known[7], rows[11], rows[12] = [0.0] * 12, [0.0] * 12, known[3]
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, v array<double>")
    ex = spark.createDataFrame([(f"e{i:03d}", v) for i, v in enumerate(known)], "e string, w array<double>")
    unit = lambda m: np.array(m) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    similarity = np.round(unit(rows) @ unit(known).T, 12)
    for threshold, block in ((0.95, 4096), (0.95, 5), (0.3, 4096), (-0.5, 50)):
        got = matching.nearest_vector(df, "id", "v", ex, "e", "w", threshold, block).collect()
        want = {(i, f"e{s.argmax():03d}") for i, s in enumerate(similarity) if s.max() >= threshold}
        assert {(r.id, r.e) for r in got} == want and len(got) == len(want)
    rings = matching.in_rings(df.toDF("_id", "_v"), ex.toDF("_ex", "_v"), 0.95)
    sizes = [t.groupBy("_cell", "_ring").count().withColumnRenamed("count", n) for t, n in zip(rings, "ab")]
    compared = sizes[0].join(sizes[1], ["_cell", "_ring"]).selectExpr("sum(a * b)").first()[0]
    assert rings[0].count() == 899 and compared < 0.2 * 900 * 240


def test_confusion_and_ratios_with_zero_denominators(spark):
    rows = [(True, True, False), (True, False, False), (False, True, False), (False, False, False)]
    df = spark.createDataFrame(rows, "y boolean, a boolean, b boolean")
    got = {r.model: r for r in scoring.with_ratios(scoring.confusion(df, "y", ["a", "b"])).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].tn, got["a"].fn) == (1, 1, 1, 1)
    assert (got["a"].precision, got["a"].recall, got["a"].f1) == (0.5, 0.5, 0.5)
    assert (got["b"].tp, got["b"].fn, got["b"].precision, got["b"].recall, got["b"].f1) == (0, 2, 0.0, 0.0, 0.0)
    empty = scoring.with_ratios(scoring.confusion(df.where("false"), "y", ["a"])).first()
    assert (empty.tp, empty.f1) == (0, 0.0)
