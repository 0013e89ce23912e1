"""A training corpus from ``documents``: each stage takes what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from guardlake.llm import exact, mixing, packing, quality, simhash
from guardlake.llm.common import table, tokenizer_path
from guardlake.session import settled


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels of these documents, does not reject.

    Only rows that are fitted are measured before; every row is measured where it is judged. Null and empty texts
    are judged like others; ties have one score; repeated rows are judged alike. Without rows none come out.
    """
    labels = table(spark, sf_dir, "labels")
    stats = settled(quality.statistics(quality.labelled(docs, labels)), "statistics")
    model = quality.fit(stats, labels)
    return docs.where(quality.text_score(model, spark)("text") >= quality.GOOD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space apart: the longest, then the smallest id. Null texts are empty ones."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of fingerprints linked at four bits or fewer, the smallest id; rows of one id or of none fold too.

    Null and empty texts share the fingerprint 0.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row per document and epoch with the words the mix takes of it.

    Null and empty texts have no words, so the mix takes nothing of them; a null source is one of its own, the last.
    """
    return mixing.mixed_documents(docs, block_words=MIX_BLOCK_WORDS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their place in a training sequence; a null or empty text is one end id."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), remember=REMEMBERED).withColumnRenamed("id", "doc_id")


#: Words of a mixed block: long, so that a source taken in part still gives long stretches of text.
MIX_BLOCK_WORDS = 1_024
#: Words the tokenizing tasks remember: fewer than a query of its own may, as workers still hold what earlier stages left.
REMEMBERED = 400_000
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The fitted classifier cannot be written as SQL; the stages are tested one by one against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "stage_" + name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
