"""Corpus rows: class projection, keep-first dedup, quotas, unions, data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guardlake.functions import fixed_values as fv
from guardlake.functions.text import differs, longer_than
from guardlake.functions.verdicts import ROLE_ERROR
from guardlake.session import settled


def attack_rows(df: DataFrame, text: str, completion: str, id_col: str) -> DataFrame:
    """Attack class: no give-away completion (null stays), long enough, first copy of each text."""
    kept = df.where(differs(F.col(completion), fv.GIVE_AWAY_COMPLETION) & longer_than(F.col(text)))
    first = keep_first(kept.select(id_col, F.col(text).alias("text")), ["text"], id_col)
    return first.withColumn("prompt_injection", F.lit(True))


def benign_rows(
    df: DataFrame, text: str, id_col: str, lang: str | None = None, role: str | None = None,
    languages: Sequence[str] = fv.BENIGN_LANGUAGES, role_value: str = fv.BENIGN_ROLE,
) -> DataFrame:
    """Benign class: filtered by language and role, neither deduplicated nor length-filtered."""
    keep = F.lit(True)
    if lang is not None:
        keep = keep & F.col(lang).isin(*languages)
    if role is not None:
        keep = keep & (F.col(role) == role_value)
    return df.where(keep).select(id_col, F.col(text).alias("text"), F.lit(False).alias("prompt_injection"))


def keep_first(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the smallest ``order``, which is unique; equal nulls are one key.

    Keys are grouped by their digest and meet the rows again by ``order``, so
    copies collapse map-side and no long text is sorted or shuffled as a key.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(name).cast("string")), F.lit("n")) for name in key]
    digest = F.sha2(F.concat_ws(",", *[F.sha2(part, 256) for part in parts]), 256)
    first = df.groupBy(digest.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(settled(first, "first-rows"), order, "left_semi")


def class_quota(n: int) -> dict[bool, int]:
    """Half attack, half benign; an odd ``n`` gives benign one more."""
    attack = int(n * 0.5)
    return {True: attack, False: n - attack}


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


def null_report(df: DataFrame, column: str) -> DataFrame:
    """Row count and null count of a prediction column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_null")
    )


def require_not_null(df: DataFrame, column: str, text: str) -> DataFrame:
    """Fail the job when a prediction is null."""
    problem = F.concat(F.lit("no prediction for text: "), F.coalesce(F.col(text), F.lit("")))
    checked = F.when(F.col(column).isNull(), F.raise_error(problem).cast(df.schema[column].dataType))
    return df.withColumn(column, checked.otherwise(F.col(column)))


def role_violations(df: DataFrame, role: str, allowed: Sequence[str] = fv.ROLES) -> DataFrame:
    """Rows whose role is not allowed; a null role is not allowed either."""
    return df.where(~F.coalesce(F.col(role).isin(*allowed), F.lit(False)))


def require_role(col: Column, allowed: Sequence[str] = fv.ROLES) -> Column:
    return F.when(col.isin(*allowed), col).otherwise(
        F.raise_error(F.lit(ROLE_ERROR)).cast("string")
    )
