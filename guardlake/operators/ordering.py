"""Positions, splits, shuffles and samples that depend on a row order.

A table has no order, so each operator takes an ordering key. None of them ranks
a whole table, class or session in one window: rows are ranked inside ranges of
the key, and the ranges' counts, one short row per range, carry the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from guardlake.functions import fixed_values as fv
from guardlake.session import settled

# Groups up to this many rows are ordered by one task; larger ones are spread.
HOT_ROWS = 100_000


def split_hot(
    df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of groups too large for one task (``None`` if there are none).

    One narrow pass counts the groups, collapsing copies of a key map-side. At
    most ``rows / hot_rows`` keys can be hot; they are settled, so the planner
    broadcasts them only if their files are small.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    hot = settled(sizes.where(F.col("_rows") > hot_rows).select(*group), "hot-groups")
    if hot.isEmpty():
        return df, None
    return join_null_safe(df, hot, group, "left_anti"), join_null_safe(df, hot, group, "left_semi")


def join_null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be null, keeping the left side's keys."""
    tagged = right.withColumnsRenamed({name: f"_r_{name}" for name in names})
    on = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"_r_{name}")) for name in names])
    return left.join(tagged, on, how).drop(*[f"_r_{name}" for name in names if how not in ("left_semi", "left_anti")])


def running_totals(
    df: DataFrame, totals: dict[str, Column], order: Sequence[str], group: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inclusive running sums of ``totals`` along ``order`` (keys of any type), per ``group``.

    Ordinary groups take one window. Hot groups, and a table without groups, are
    spread over ranges of the order key.
    """
    if not group:
        return _spread_totals(df, totals, order, [])
    cold, hot = split_hot(df, group, hot_rows)
    along = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = cold.withColumns({name: F.sum(value).over(along) for name, value in totals.items()})
    return done if hot is None else done.unionByName(_spread_totals(hot, totals, order, list(group)))


def _spread_totals(df: DataFrame, totals: dict[str, Column], order: Sequence[str], group: list[str]) -> DataFrame:
    """Rows are ranged once and written with the number of their range.

    Sums run inside a range; a range starts from the sums of the ranges before
    it, and there are no more of those per group than shuffle partitions.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    ranged = settled(ranged, "ranges")
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "_range").agg(*[F.sum(value).alias(f"_o_{name}") for name, value in totals.items()])
    starts = sums.select(
        *group, "_range", *[F.coalesce(F.sum(f"_o_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in totals]
    )
    local = ranged.withColumns({name: F.sum(value).over(inside) for name, value in totals.items()})
    joined = join_null_safe(local, settled(starts, "range-starts"), [*group, "_range"])
    return joined.withColumns({name: F.col(name) + F.col(f"_o_{name}") for name in totals}).drop(
        "_range", *[f"_o_{name}" for name in totals]
    )


def with_position(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "position", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Dense positions from 0 along ``order``, per ``group``."""
    counted = running_totals(df, {name: F.lit(1)}, order, group, hot_rows)
    return counted.withColumn(name, F.col(name) - 1)


def systematic_sample(
    df: DataFrame, id_col: str, step: int = fv.SAMPLE_STEP, head: int | None = fv.SAMPLE_HEAD
) -> DataFrame:
    """Every ``step``-th row in id order, then the first ``head`` of those.

    With a head only the first ``step * head`` ids can matter, so no more are ranked.
    """
    first = df.select(id_col)
    if head is not None:
        first = first.orderBy(id_col).limit((head - 1) * step + 1)
    wanted = with_position(first, [id_col], name="_position").where(F.col("_position") % step == 0).select(id_col)
    return df.join(settled(wanted, "sampled-ids"), id_col, "left_semi")


def order_key(id_col: Column, seed: int = fv.SPLIT_SEED) -> Column:
    """A reproducible pseudo-random key per row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def with_shuffle_key(df: DataFrame, id_col: str, seed: int = fv.SPLIT_SEED) -> DataFrame:
    return df.withColumn("shuffle_key", order_key(F.col(id_col), seed))


def exact_split(
    df: DataFrame, id_col: str, stratum: str, seed: int = fv.SPLIT_SEED
) -> DataFrame:
    """Exact 80/10/10 split inside each stratum, in order of the seeded key.

    Two cut keys per stratum decide every row, so the texts are never shuffled:
    bucket counts, at most a million short rows per stratum and settled because
    they are used twice, find the bucket that holds each cut, and only the rows
    of those few buckets are ranked to read the cut key.
    """
    keyed = df.select(F.col(stratum), order_key(F.col(id_col), seed).alias("_key"))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, 5))
    counts = settled(keyed.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "bucket-counts")
    sizes = counts.groupBy(stratum).agg(F.sum("_n").alias("_size"))
    upto = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ladder = counts.withColumn("_upto", F.sum("_n").over(upto))

    holdout = F.ceil(F.col("_size") * fv.HOLDOUT_SHARE).cast("bigint")
    validation = F.ceil(holdout * fv.VALIDATION_SHARE).cast("bigint")
    cuts = sizes.select(
        stratum,
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("_cut"), (F.col("_size") - holdout).alias("_rank")),
                F.struct(F.lit("test").alias("_cut"), (F.col("_size") - validation).alias("_rank")),
            )
        ).alias("c"),
    ).select(stratum, "c.*")
    held = join_null_safe(ladder, cuts, [stratum]).where(
        (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
    )
    held = held.select(stratum, "_bucket", "_cut", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    # A boolean stratum has at most three values: at most six cut buckets and three rows of cut keys.
    few = isinstance(df.schema[stratum].dataType, T.BooleanType)
    held = F.broadcast(held) if few else held
    nth = Window.partitionBy(stratum, "_bucket", "_cut").orderBy("_key")
    keys = (
        join_null_safe(keyed, held, [stratum, "_bucket"])
        .withColumn("_nth", F.row_number().over(nth))
        .where(F.col("_nth") == F.col("_rank"))
        .groupBy(stratum)
        .agg(
            F.max(F.when(F.col("_cut") == "train", F.col("_key"))).alias("_train"),
            F.max(F.when(F.col("_cut") == "test", F.col("_key"))).alias("_test"),
        )
    )
    keys = F.broadcast(keys) if few else keys
    key = order_key(F.col(id_col), seed)
    split = (
        F.when(key <= F.col("_train"), "train").when(key <= F.col("_test"), "test").otherwise("val")
    )
    return join_null_safe(df, keys, [stratum], "left").withColumn("split", split).drop("_train", "_test")


def hash_split(df: DataFrame, id_col: str, seed: int = fv.SPLIT_SEED) -> DataFrame:
    """Approximate 80/10/10 split from the row's own key: no shuffle, stable when rows are added."""
    bucket = F.conv(F.substring(order_key(F.col(id_col), seed), 1, 8), 16, 10).cast("bigint") % 10
    split = F.when(bucket < 8, "train").when(bucket == 8, "test").otherwise("val")
    return df.withColumn("split", split)
