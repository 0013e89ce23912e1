"""Detectors, confusion counts and ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from guardlake.functions import text as tx
from guardlake.functions.text import tokens
from guardlake.session import settled


def score(df: DataFrame, detectors: Mapping[str, Column]) -> DataFrame:
    """All detectors in one pass over the rows, one boolean column each. Rows carry through, so no join."""
    return df.withColumns(dict(detectors))


def model_detector(load: Callable[[], Callable[[Any], Any]]) -> Callable[[Column], Column]:
    """A detector that needs Python: ``load`` runs once per worker, then sees Arrow batches of texts."""

    @F.pandas_udf("boolean")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield model(texts)

    return detect


def align_predictions(df: DataFrame, predictions: DataFrame, id_col: str) -> DataFrame:
    """Predictions kept elsewhere are brought back by id; a missing one shows as null."""
    return df.join(predictions, id_col, "left")


def confusion(df: DataFrame, label: str, predictions: list[str], keys: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn per detector, from one scan and one aggregate for all of them."""
    keys = keys or []
    actual = F.col(label)
    counts = []
    for name in predictions:
        said = F.col(name)
        counts += [
            F.count_if(said & actual).alias(f"{name}_tp"), F.count_if(said & ~actual).alias(f"{name}_fp"),
            F.count_if(~said & ~actual).alias(f"{name}_tn"), F.count_if(~said & actual).alias(f"{name}_fn"),
        ]
    wide = df.groupBy(*keys).agg(*counts)
    long = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("model"), *[F.col(f"{name}_{c}").alias(c) for c in ("tp", "fp", "tn", "fn")])
                for name in predictions
            ]
        )
    ).alias("m")
    return wide.select(*keys, long).select(*keys, "m.*")


def with_ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; 0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    precision, recall = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero))
        .withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero))
        .withColumn(
            "f1", F.when((precision > 0) & (recall > 0), 2 / (1 / precision + 1 / recall)).otherwise(zero)
        )
    )


def accuracy_and_prior(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of rows where label and prediction agree, and share of positive labels."""
    return df.agg(
        F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"),
        F.avg(F.col(label).cast("int")).alias("prior"),
    )


def text_vectors(df: DataFrame, id_col: str, text: str, dims: int = 256, name: str = "vector") -> DataFrame:
    """``(id, vector)``: unit-length TF-IDF over token buckets, a token's bucket being an md5 of it modulo ``dims``.

    Native throughout: counts per (text, bucket) fold map-side, and only they are
    shuffled. The inverse frequencies are one row of ``dims`` numbers. A text without tokens, or null, has zeros.
    """
    bucket = F.conv(F.substring(F.md5("_t"), 1, 8), 16, 10).cast("bigint") % dims
    tokens_of = tx.never_null(tokens(F.col(text)))
    counts = df.select(F.col(id_col).alias("_id"), F.explode_outer(tokens_of).alias("_t")).groupBy(
        "_id", bucket.alias("_b")
    ).agg(F.count("_t").alias("_n"))
    counts = settled(counts, "token-counts")
    seen = counts.where("_b IS NOT NULL").groupBy("_b").agg(F.count(F.lit(1)).alias("_df"))
    idf = seen.select("_b", F.log(F.lit(df.count() + 1) / (F.col("_df") + 1)).alias("_idf"))  # at most dims rows
    weighted = counts.join(F.broadcast(idf), "_b", "left").select("_id", "_b", (F.col("_n") * F.col("_idf")).alias("_x"))
    entry = F.when(F.col("_b").isNotNull(), F.struct("_b", "_x"))
    rows = weighted.groupBy("_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"), F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_l"))
    x = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")),
        lambda b: F.when(F.col("_l") > 0, F.coalesce(F.try_element_at("_m", b) / F.col("_l"), F.lit(0.0))).otherwise(F.lit(0.0)),
    )
    return rows.select(F.col("_id").alias(id_col), x.alias(name))


def _features(dims: int) -> list:
    return [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]


def train_classifier(
    train: DataFrame, text: str, label: str, dims: int = 1 << 16, max_iter: int = 20
) -> PipelineModel:
    """A trainable detector: hashed TF-IDF and logistic regression, fitted on the train split."""
    regression = LogisticRegression(featuresCol="_unit", labelCol="_label", maxIter=max_iter, predictionCol="_class")
    rows = train.select(tokens(F.col(text)).alias("_tokens"), F.col(label).cast("double").alias("_label"))
    return Pipeline(stages=[*_features(dims), regression]).fit(rows)


def classify(model: PipelineModel, df: DataFrame, text: str, name: str = "predictions") -> DataFrame:
    scored = model.transform(df.withColumn("_tokens", tokens(F.col(text))))
    probability = F.element_at(vector_to_array("probability"), 2).alias(f"{name}_probability")
    return scored.select(*df.columns, (F.col("_class") == 1.0).alias(name), probability)
