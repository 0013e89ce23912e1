import datetime
import math
import random

from pyspark.sql import functions as F

from guardlake.operators import profile
from guardlake.sources import readers


def test_messages_span_lines_and_parts_of_files(spark, tmp_path):
    rng = random.Random(1)
    written = []
    for name in ("a.log", "b.log", "c.log"):
        lines = ["left over from before", ""] if name == "b.log" else []
        for i in range(400):
            body = "\n".join(rng.choice(["x" * 30, "", "  User: 'no'", "12.01.2025 not a stamp"]) for _ in range(rng.randrange(4)))
            who = rng.choice(["User: '{}'", "Chatbot: '{}'", "read_query called {}"]).format(f"{name} {i}" + ("\n" + body if body else ""))
            written.append(who)
            lines += f"0{1 + i % 9}.01.2025 10:00:{i % 60:02d} INFO {who}".split("\n")
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        parsed, before = readers.read_messages(spark, str(tmp_path))
        for hot in (100_000, 50):
            joined = readers.join_messages(readers.numbered_lines(spark, str(tmp_path)), hot_rows=hot)
            assert joined.where("message_no > 0").count() == len(written)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = parsed.collect()
    assert sorted(r.message for r in rows) == sorted(written)
    spoken = [r for r in rows if r.speaker]
    assert all(f"{r.speaker}: '{r.text}'" == r.message for r in spoken) and any("\n" in r.text for r in spoken)
    assert [r.value for r in before.collect()] == ["left over from before\n"]


def test_stored_profiles_merge(spark):
    big = 2**60
    rows = [(datetime.date(2025, 1, 1 + i % 5), big + i, None if i % 7 == 0 else i / 3, None) for i in range(2000)]
    rows += [(None, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "day date, n bigint, x double, nothing double")
    stored = profile.profile_rows(df, ["n", "x", "nothing"], ["day"])
    assert stored.count() == 18
    merged = {r["column"]: r for r in profile.merged_profile(stored.repartition(3), [], {"median": 0.5}).collect()}
    n, x, nothing = merged["n"], merged["x"], merged["nothing"]
    assert (n.n_rows, n.n_null, n.min_int, n.max_int) == (2001, 1, big, big + 1999)
    assert abs(n.approx_distinct / 2000 - 1) < 0.07 and x.min_int is None
    assert (nothing.n_null, nothing["median"], nothing["min"], nothing.mean) == (2001, None, None, None)
    finite = profile.merged_profile(profile.profile_rows(df.where("NOT isnan(x)"), ["x"], ["day"]), []).first()
    values = [v for _, _, v, _ in rows[:-1] if v is not None]
    mean = sum(values) / len(values)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))
    assert math.isclose(finite.mean, mean) and math.isclose(finite.stddev, deviation)
    rank = sum(v <= finite["median"] for v in values) / len(values)
    assert abs(rank - 0.5) < 0.04
    by_day = profile.merged_profile(stored, ["day"])
    assert by_day.count() == 18


def test_exact_quantiles_of_ranges_equal_percentile(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50), None if i % 9 == 0 else rng.random(), 2**60 + i // 2, None) for i in range(5000)]
    rows += [(None, float("nan"), None, None), (None, 0.0, None, None)]
    df = spark.createDataFrame(rows, "few int, x double, big bigint, nothing double").repartition(3)
    ranks = {"a": 0.0, "b": 0.49, "c": 0.5, "d": 0.9, "e": 1.0}
    for some in (df, spark.createDataFrame(rows[:1], df.schema), df.where("false")):
        got = {r["column"]: r for r in profile.exact_quantiles(some, df.columns, ranks).collect()}
        for c in df.columns:
            one = some.agg(F.countDistinct(c), *[F.percentile(F.col(c).cast("double"), q) for q in ranks.values()]).first()
            assert str(tuple(got[c])[1:]) == str(tuple(one)), c
    # No task holds all values of a column, as the aggregate did.
    plan = profile.exact_quantiles(df, ["x"], {"c": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
