import math
import random

from pyspark.sql import functions as F

from guardlake.operators import curate, ordering


def test_positions_are_dense_with_and_without_hot_groups(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**13), 1500) + list(range(500))
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice("abc") if rng.random() < 0.9 else None) for i in ids]
    df = spark.createDataFrame(rows, "id bigint, g string")
    alone = {r.id: r.position for r in ordering.with_position(df, ["id"]).collect()}
    assert alone == {i: n for n, i in enumerate(sorted(ids))}
    want = {}
    for g in {g for _, g in rows}:
        want |= {i: n for n, i in enumerate(sorted(i for i, h in rows if h == g))}
    for hot_rows in (5, 400, 10**6):
        got = ordering.with_position(df, ["id"], group=["g"], hot_rows=hot_rows)
        assert {r.id: r.position for r in got.collect()} == want


def test_positions_along_keys_of_any_type(spark):
    rng = random.Random(7)
    days = rng.sample(range(20_000), 300)
    rows = [(f"k{d:05d}", d, rng.choice("ab")) for d in days]
    df = spark.createDataFrame(rows, "s string, d int, g string").withColumns(
        {"t": F.timestamp_seconds(F.col("d") * 86400), "p": F.struct(F.col("d") % 3, F.col("s"))}
    )
    for key in ("s", "t", "p"):
        placed = ordering.with_position(df, [key], name="n").collect()
        assert [r.n for r in sorted(placed, key=lambda r: r[key])] == list(range(300))
        for hot_rows in (5, 10**6):
            grouped = ordering.with_position(df, [key], group=["g"], name="n", hot_rows=hot_rows).collect()
            for g in "ab":
                own = sorted((r for r in grouped if r.g == g), key=lambda r: r[key])
                assert [r.n for r in own] == list(range(len(own)))


def test_exact_split_sizes_disjoint_complete(spark):
    for n in (1, 2, 7, 10, 33):
        df = spark.createDataFrame([(i, i >= n) for i in range(2 * n)], "id bigint, prompt_injection boolean")
        rows = ordering.exact_split(df, "id", "prompt_injection").collect()
        assert sorted(r.id for r in rows) == list(range(2 * n))
        holdout = math.ceil(n * 0.2)
        val = math.ceil(holdout * 0.5)
        for label in (True, False):
            count = {s: sum(r.split == s and r.prompt_injection == label for r in rows) for s in ("train", "test", "val")}
            assert count == {"train": n - holdout, "test": holdout - val, "val": val}


def test_hash_split_is_stable_when_rows_are_added(spark):
    small = {r.id: r.split for r in ordering.hash_split(spark.range(100), "id").collect()}
    large = {r.id: r.split for r in ordering.hash_split(spark.range(1000), "id").collect()}
    assert all(large[i] == s for i, s in small.items())


def test_systematic_sample(spark):
    df = spark.range(1000).withColumn("id", F.col("id") * 7 + 3)
    want = [i * 7 + 3 for i in range(0, 1000, 30)]
    assert sorted(r.id for r in ordering.systematic_sample(df, "id", head=5).collect()) == want[:5]
    assert sorted(r.id for r in ordering.systematic_sample(df, "id").collect()) == want
    assert sorted(r.id for r in ordering.systematic_sample(df, "id", head=None).collect()) == want


def test_keep_first_and_quota(spark):
    rows = [(3, "a", "x"), (1, "a", "y"), (2, "b", None), (4, None, "n"), (5, None, "m")]
    df = spark.createDataFrame(rows, "id bigint, text string, extra string")
    assert {tuple(r) for r in curate.keep_first(df, ["text"], "id").collect()} == {(1, "a", "y"), (2, "b", None), (4, None, "n")}
    assert curate.class_quota(7) == {True: 3, False: 4}


def test_attack_rows(spark):
    long = "x" * 31
    rows = [(1, long, None), (2, long, "other"), (3, long + "y", "I have been PWNED"), (4, "short", None), (5, None, None)]
    df = spark.createDataFrame(rows, "id bigint, user_input string, expected_completion string")
    got = curate.attack_rows(df, "user_input", "expected_completion", "id").collect()
    assert [tuple(r) for r in got] == [(1, long, True)]


def test_null_and_role_checks(spark):
    import pytest

    df = spark.createDataFrame([(1, "a", True), (2, "b", None)], "id bigint, text string, p boolean")
    assert tuple(curate.null_report(df, "p").first()) == (2, 1)
    with pytest.raises(Exception, match="no prediction for text: b"):
        curate.require_not_null(df, "p", "text").collect()
    roles = spark.createDataFrame([("user",), ("User",), (None,), ("system",)], "role string")
    assert [r.role for r in curate.role_violations(roles, "role").collect()] == ["User", None]
    with pytest.raises(Exception, match="a message needs one of the roles"):
        roles.select(curate.require_role(F.col("role"))).collect()
