"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from guardlake.functions import fixed_values as fv
from guardlake.functions.verdicts import two_decimals
from guardlake.operators.ordering import join_null_safe, with_position
from guardlake.sources.readers import path_exists

METRIC_KEYS = ["dataset", "model"]
METRIC_COLUMNS = ["dataset", "model", "precision", "recall", "f1", "tp", "fp", "tn", "fn"]
METRIC_SCHEMA = (
    "dataset string, model string, precision double, recall double, f1 double, "
    "tp bigint, fp bigint, tn bigint, fn bigint"
)


def write_splits(df: DataFrame, path: str, shuffle_key: str = "shuffle_key") -> None:
    """One folder per split, rows in shuffled order inside each file.

    Ranging on (split, shuffle key) spreads one split over many tasks, so the
    train split, four fifths of the data, is not written by one task.
    """
    (
        df.repartitionByRange("split", shuffle_key)
        .sortWithinPartitions("split", shuffle_key)
        .write.mode("overwrite")
        .partitionBy("split")
        .parquet(path)
    )


def not_stored(new: DataFrame, stored: DataFrame, keys: list[str] = METRIC_KEYS) -> DataFrame:
    """New rows whose key is not stored yet. Keys are compared whole; null keys match."""
    return join_null_safe(new, stored.select(*keys).distinct(), keys, "left_anti")


def append_metrics(metrics: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """Append only metric rows that are not stored, and return the stored table.

    Of a key that repeats in the batch one row is stored: the first by ``order``,
    or without one the smallest by the columns in their order.
    """
    spark = metrics.sparkSession
    values = [c for c in METRIC_COLUMNS if c not in METRIC_KEYS]
    first = F.min(F.struct(*([order] if order else []), *values)).alias("_first")
    fresh = metrics.groupBy(*METRIC_KEYS).agg(first).select(*METRIC_KEYS, *[f"_first.{c}" for c in values])
    if path_exists(spark, path):
        fresh = not_stored(fresh, spark.read.schema(METRIC_SCHEMA).parquet(path))
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(METRIC_SCHEMA).parquet(path)


def export_metrics_csv(metrics: DataFrame, path: str) -> None:
    """CSV with two-decimal ratios; the stored table keeps full doubles."""
    metrics.select(
        "dataset", "model",
        *[two_decimals(F.col(name)).alias(name) for name in ("precision", "recall", "f1")],
        "tp", "fp", "tn", "fn",
    ).write.mode("overwrite").csv(path, header=True)


def write_wide(df: DataFrame, path: str, format: str = "parquet") -> None:
    if format == "csv":
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").format(format).save(path)


def append_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(column).write.mode("append").text(path)


def seed_rows(emails: DataFrame, position: str = "position", column: str = "email", seed: int = fv.SPLIT_SEED) -> DataFrame:
    """Rows of the protected table: a list of addresses numbered from 0 in list order, repeats kept, and quantities.

    ``position`` (unique, of any type) gives the order of the list. The quantity, 0
    to 200, follows from an md5 of the address's place and text, so a lost task rebuilds the same rows.
    """
    numbered = with_position(emails.select(position, column), [position], name="user_id")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col(column)))
    quantity = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % (fv.MAX_SEED_QUANTITY + 1)
    return numbered.select("user_id", F.col(column).alias("email"), quantity.alias("order_quantity"))


def seed_table(spark: SparkSession, emails: DataFrame, path: str, replace: bool, position: str = "position") -> DataFrame:
    """Load the protected table: always (``replace``) or only while it holds no row."""
    schema = "user_id bigint, email string, order_quantity bigint"
    if not replace and path_exists(spark, path) and not spark.read.schema(schema).parquet(path).isEmpty():
        return spark.read.schema(schema).parquet(path)
    seed_rows(emails, position).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)
