"""Column profiles, pair metrics and log counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from guardlake.functions.text import text_metrics, word_overlap
from guardlake.session import settled


def prompt_response_pairs(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each user message with the assistant message of the next turn. The key is one row per side."""
    prompts = turns.where(F.col(role) == "user").select(conv, turn, F.col(text).alias("prompt"))
    replies = turns.where(F.col(role) == "assistant").select(
        conv, (F.col(turn) - 1).alias(turn), F.col(text).alias("response")
    )
    return prompts.join(replies, [conv, turn])


def pair_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.select(
        *keys,
        *[c.alias(n) for n, c in text_metrics(F.col("prompt"), "prompt").items()],
        *[c.alias(n) for n, c in text_metrics(F.col("response"), "response").items()],
        word_overlap(F.col("prompt"), F.col("response")).alias("overlap"),
    )


def numeric_profile(
    df: DataFrame, columns: list[str], sketches: bool = True, accuracy: int = 10_000
) -> DataFrame:
    """One row per numeric column from one pass, with sketches for distinct count and median."""
    aggregates = []
    for name in columns:
        value = F.col(name).cast("double")
        aggregates.append(
            F.struct(
                F.lit(name).alias("column"), F.count(F.lit(1)).alias("n_rows"),
                F.count_if(value.isNull()).alias("n_null"), F.min(value).alias("min"), F.max(value).alias("max"),
                F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"),
                *([
                    F.approx_count_distinct(value).alias("approx_distinct"),
                    F.percentile_approx(value, 0.5, accuracy).alias("median"),
                ] if sketches else []),
            )
        )
    return df.agg(F.array(*aggregates).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")


def exact_quantiles(df: DataFrame, columns: list[str], ranks: dict[str, float]) -> DataFrame:
    """One row per numeric column: the exact number of distinct values and exact quantiles, interpolated like ``percentile``.

    Copies of a value collapse map-side into a histogram that is ranged once by column and value. The counts of the ranges, one
    short row each, tell which few ranges hold a wanted place, and only the rows of those are summed up in order.
    """
    whole = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("_i"), (F.col(name) if name in whole else F.lit(None)).cast("bigint").alias("_whole"),
            F.col(name).cast("double").alias("_value"),
        )
        for i, name in enumerate(columns)
    ])
    values = df.select(F.explode(cells).alias("c")).select("c.*").where("_value IS NOT NULL")
    histogram = values.groupBy("_i", "_whole", "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranged = histogram.repartitionByRange("_i", "_value", "_whole").withColumn("_range", F.spark_partition_id())
    ranged = settled(ranged, "histogram")
    along = Window.partitionBy("_i").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_i", "_range").agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_distinct"))
    ladder = settled(sums.withColumn("_before", F.sum("_sum").over(along) - F.col("_sum")), "range-sums")
    sizes = ladder.groupBy("_i").agg(F.sum("_sum").alias("_size"), F.sum("_distinct").alias("n_distinct"))

    place = (F.col("_size") - 1) * F.col("q.q")
    wanted = sizes.select("_i", "_size", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(rank)).alias("q")) for name, rank in ranks.items()
    ])).alias("q")).select("_i", "q.name", place.alias("_place"))
    wanted = wanted.withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
    inside = (F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_sum"))
    # At most two places per column and rank.
    held = F.broadcast(ladder.join(wanted, "_i").where(inside).select("_i", "_range", "_before", "name", "_place", "_at"))
    few = ranged.join(held, ["_i", "_range"], "left_semi")
    upto = Window.partitionBy("_i", "_range").orderBy("_value", "_whole").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_before") + F.col("_upto")
    met = few.withColumn("_upto", F.sum("_n").over(upto)).join(held, ["_i", "_range"]).where(
        (F.col("_at") < last) & (F.col("_at") >= last - F.col("_n"))
    )
    ends = met.groupBy("_i", "name", "_place").agg(
        F.min_by("_value", "_at").alias("_low"), F.max_by("_value", "_at").alias("_high"), F.floor("_place").alias("_floor")
    )
    between = (F.col("_floor") + 1 - F.col("_place")) * F.col("_low") + (F.col("_place") - F.col("_floor")) * F.col("_high")
    value = F.when((F.col("_low") == F.col("_high")) | (F.col("_place") == F.col("_floor")), F.col("_low")).otherwise(between)
    found = ends.select("_i", "name", value.alias("_value")).groupBy("_i").agg(
        *[F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in ranks]
    )
    listed = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("_i", "column"))
    return listed.join(sizes, "_i", "left").join(found, "_i", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"), *ranks
    )


PROFILE_SCHEMA = (
    "column string, n_rows bigint, n_null bigint, min_int bigint, max_int bigint, min double, max double,"
    " mean double, m2 double, distinct_sketch binary, quantile_sketch binary"
)


def profile_rows(df: DataFrame, columns: list[str], by: list[str], lg_k: int = 12, k: int = 200) -> DataFrame:
    """Profiles to store: one row per group of ``by`` (a day, say) and numeric column, from one pass.

    Whole numbers keep their exact extremes in ``min_int`` and ``max_int``. The sketches (HyperLogLog for distinct values, with a
    relative error of about 1.04 / sqrt(2^lg_k); KLL for quantiles, with a rank error of about 1.7 / k^0.9) are of
    fixed size and merge with those of other rows.
    """
    whole = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("column"), (F.col(name) if name in whole else F.lit(None)).cast("bigint").alias("whole"),
            F.col(name).cast("double").alias("value"),
        )
        for name in columns
    ])
    flat = df.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    value, used = F.col("value"), F.col("value").isNotNull() & ~F.isnan("value")
    exact = F.coalesce(F.col("whole").cast("string"), value.cast("string"))
    return flat.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(value.isNull()).alias("n_null"),
        F.min("whole").alias("min_int"), F.max("whole").alias("max_int"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"),
        F.hll_sketch_agg(exact, F.lit(lg_k)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.when(used, value), F.lit(k)).alias("quantile_sketch"),
    ).select(*by, *[part.split()[0] for part in PROFILE_SCHEMA.split(", ")])


def merged_profile(rows: DataFrame, by: list[str], ranks: dict[str, float] | None = None) -> DataFrame:
    """One row per group of ``by`` and column, from stored profiles of any number and order.

    Counts and extremes are exact, mean and deviation up to rounding; ``approx_distinct`` and the quantiles of ``ranks`` (by
    default the median) lie within the errors of the sketches.
    """
    keys = [*by, "column"]
    of_column = Window.partitionBy(*keys)
    n = F.col("n_rows") - F.col("n_null")
    centred = rows.withColumn("_n", n).withColumn(
        "_mean", F.sum(F.col("mean") * n).over(of_column) / F.nullif(F.sum(n).over(of_column), F.lit(0))
    )
    total = F.sum("_n")
    squares = F.sum(F.col("m2") + F.col("_n") * (F.col("mean") - F.col("_mean")) ** 2)
    merged = centred.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.min("min_int").alias("min_int"), F.max("max_int").alias("max_int"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.max("_mean").alias("mean"),
        F.when(total > 1, F.sqrt(squares / (total - 1))).alias("stddev"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("approx_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("_quantiles"), total.alias("_used"),
    )
    quantiles = {
        name: F.when(F.col("_used") > 0, F.kll_sketch_get_quantile_double("_quantiles", F.lit(rank)))
        for name, rank in (ranks or {"median": 0.5}).items()
    }
    return merged.withColumns(quantiles).drop("_quantiles", "_used")


def text_profile(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Exact profile of text lengths per group.

    Rows first collapse map-side into a histogram of (group, length), at most
    one row per possible length, so the exact percentiles never see the rows.
    """
    length = F.length(text).cast("bigint")
    histogram = df.groupBy(*by, length.alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    present = F.when(F.col("_len").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    total = F.sum(present)
    mean = F.sum(F.col("_len") * F.col("_n")) / F.nullif(total, F.lit(0))
    square = F.sum(F.col("_len").cast("double") * F.col("_len") * F.col("_n"))
    variance = (square - total * mean * mean) / F.nullif(total - 1, F.lit(0))
    return histogram.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"),
        (F.sum("_n") - total).alias("n_null"),
        F.min("_len").alias("min_len"),
        F.max("_len").alias("max_len"),
        mean.alias("mean_len"),
        F.when(total > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("stddev_len"),
        F.percentile("_len", 0.5, F.col("_n")).alias("median_len"),
        F.percentile("_len", 0.9, F.col("_n")).alias("p90_len"),
    )


def distinct_count(df: DataFrame, column: Column, by: list[str], name: str) -> DataFrame:
    """Exact distinct count through a hash: copies collapse map-side and long texts never travel."""
    hashed = df.select(*by, F.sha2(column, 256).alias("_h")).groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_c"))
    return hashed.groupBy(*by).agg(F.count("_h").alias(name))


def log_counts(parsed: DataFrame) -> DataFrame:
    """Lines per speaker and log level."""
    return parsed.groupBy("speaker", "level").agg(F.count(F.lit(1)).alias("n_lines"))
