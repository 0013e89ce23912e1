"""What the operators share: inputs, column names, Arrow slices and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from guardlake.session import settled

#: Folder of the public vocabulary files, unless a caller names another.
TOKENIZERS = "/opt/tokenizers"
#: Characters of text that one step inside a task holds in decoded form.
SLICE_CHARS = 2_000_000
#: Rows and bytes of an Arrow batch of texts: what a task holds on either side of the pipe to its Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file in ``folder``; by default of the installed package of public tokenizers, or ``TOKENIZERS``."""
    if folder is None:
        try:
            import public_tokenizers

            return str(public_tokenizers.path(name))
        except ImportError:
            folder = TOKENIZERS
    return f"{folder}/{name}"


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts (null: empty), a few megabytes of text each or one longer row."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    begin = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > SLICE_CHARS:
            part = batch.slice(begin, i - begin)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        part = batch.slice(begin)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold few texts at a time; the default of 10,000 rows is made for narrow ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def per_text(
    docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list, list[str]], dict]],
) -> DataFrame:
    """Map-only: ``make()`` gives, once per task, a function from ids and texts to the columns of ``schema``."""
    bounded_batches(docs.sparkSession)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    full = schema.replace("ID_TYPE", id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            kind = batch.schema.field(0).type
            for part, texts in text_slices(batch):
                made = work(part.column(0), texts)
                arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in made.values()]
                if arrays and len(arrays[0]):
                    first = arrays[0].cast(kind) if list(made)[0] == "id" else arrays[0]
                    yield pa.RecordBatch.from_arrays([first, *arrays[1:]], names=list(made))
                    del made, arrays, first
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, full)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows ``(node, root)``, ``root`` the smallest node reachable.

    Contraction: every node points to its smallest neighbour (itself included), edges are renamed to those
    pointers, and the graph at least halves each round, so the rounds are logarithmic and their files shrink
    geometrically. Rounds are written to the shared folder: no lineage grows, nothing meets on the driver but
    one row count per round. A star of any size folds in one round, its pointers pre-aggregated before the shuffle.
    """
    levels: list[DataFrame] = []
    current = settled(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        least = settled(least, "pointers")
        levels.append(least)
        left = least.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = least.select(F.col("node").alias("b"), F.col("up").alias("y"))
        renamed = current.join(left, "a").join(right, "b").where("x <> y")
        current = settled(renamed.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if not levels:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels.pop().select("node", F.col("up").alias("root"))
    while levels:
        below = levels.pop()
        above = found.select(F.col("node").alias("up"), F.col("root").alias("over"))
        found = settled(
            below.join(above, "up", "left").select("node", F.coalesce("over", "up").alias("root")), "roots"
        )
    return found
