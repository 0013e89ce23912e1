"""Corpus build: class rows, diverse subsets, exact splits, shuffled split files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from guardlake.functions import fixed_values as fv
from guardlake.operators.curate import class_quota, combine
from guardlake.operators.diverse import farthest_points, farthest_points_coreset
from guardlake.operators.ordering import exact_split, with_shuffle_key

SELECTIONS = {"exact": farthest_points, "coreset": farthest_points_coreset}


def diverse_rows(
    rows: DataFrame, vectors: DataFrame, k: int, id_col: str, vector: str, start_id: int, method: str = "exact"
) -> DataFrame:
    """The rows of a diverse subset, with their pick order; ``method`` is the caller's choice at any size."""
    picks = SELECTIONS[method](vectors, k, id_col, vector, start_id)
    return rows.join(picks.select(id_col, "pick_order"), id_col)


def build_corpus(
    attack: DataFrame, benign: DataFrame, n: int, id_col: str, vector: str,
    attack_start: int, benign_start: int, seed: int = fv.SPLIT_SEED, method: str = "exact",
) -> DataFrame:
    """``n`` rows, half attack and half benign, split per class and keyed for shuffling.

    Both inputs carry ``text``, ``prompt_injection`` and a vector per row.
    """
    quota = class_quota(n)
    chosen = [
        diverse_rows(rows.drop(vector), rows, quota[label], id_col, vector, start, method)
        for label, rows, start in ((True, attack, attack_start), (False, benign, benign_start))
        if quota[label]
    ]
    return with_shuffle_key(exact_split(combine(chosen), id_col, "prompt_injection", seed), id_col, seed)
