"""Detector evaluation: score, check, count, divide, store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from guardlake.operators.curate import require_not_null
from guardlake.operators.scoring import confusion, score, with_ratios


def evaluate(
    df: DataFrame, detectors: Mapping[str, Column], label: str, text: str, dataset: str
) -> DataFrame:
    """One metric row per detector; a null prediction fails the job."""
    scored = score(df, detectors)
    for name in detectors:
        scored = require_not_null(scored, name, text)
    counts = confusion(scored.select(label, *detectors), label, list(detectors))
    return with_ratios(counts).withColumn("dataset", F.lit(dataset)).select(
        "dataset", "model", "precision", "recall", "f1", "tp", "fp", "tn", "fn"
    )
