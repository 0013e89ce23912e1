"""Mixing sources to target weights by blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from guardlake.llm.common import unused
from guardlake.session import settled

#: Words of a block; sources of fewer than ``LEAST_BLOCKS`` such blocks are cut into so many shorter ones.
BLOCK_WORDS, LEAST_BLOCKS = 64, 64
#: Blocks of one output shard.
SHARD_SLOTS = 1_024
#: Documents of one bucket of a source's stream, about.
BUCKET_ROWS = 10_000
#: How often a source may be repeated, what all targets share of all sizes, and the weights by rank of source.
MOST, SHARE, WEIGHTS = 2.0, 1.5, (5.0, 2.0, 1.0)
#: Populations from which numpy draws exactly; digits of logarithms beyond, and their constant.
GENERATOR_RANGE, DIGITS, PI = 10**9, 45, Decimal("3.14159265358979323846264338327950288419716939937510582097")
BLANKS, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    block: int
    blocks: int
    slots: int


def words(text: Column) -> Column:
    """How many runs of anything but ASCII white space a text holds; null holds none."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), BLANKS)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares of ``share`` times all sizes by weight; none above ``most`` times its size, what is over is reshared."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        unit = rest / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else unit * weights[i]
        free = free - over if over else set()
    return out


def sources(sized: DataFrame, block_words: int = BLOCK_WORDS) -> list[Source]:
    """The catalogue of sources in order of code points, null last; one short row each on the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["size"]) for r in rows]
    aims = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    found = []
    for row, size, aim in zip(rows, sizes, aims):
        block = max(1, min(block_words, size // LEAST_BLOCKS))
        blocks = -(-size // block)
        found.append(Source(row.source, size, aim, block, blocks, round(aim * blocks / size) if size else 0))
    return found


class ShardCounts:
    """How many slots of each source a shard draws, and how many the shards before it drew.

    The counts of all shards together are multinomial draws given that every source comes to its number of slots:
    halving the range of shards, the left half's counts are one hypergeometric draw seeded by the range. A shard
    follows its own path down, so shards need nothing of each other and reruns agree; shards asked one after the other
    share what their paths have in common, and a range draws only the sources it still holds.
    """

    def __init__(self, slots: list[int], shards: int, per_shard: int, seed: int) -> None:
        counts = np.array(slots, dtype=np.int64)
        self.per_shard, self.seed = per_shard, seed
        self.path = [(0, shards, counts, np.zeros_like(counts))]

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        while not self.path[-1][0] <= shard < self.path[-1][1]:
            self.path.pop()
        low, high, counts, before = self.path[-1]
        while high - low > 1:
            mid = (low + high) // 2
            number = min((mid - low) * self.per_shard, int(counts.sum()))
            left = hypergeometric(counts, number, np.random.default_rng([self.seed, low, high]))
            if shard < mid:
                counts, high = left, mid
            else:
                counts, before, low = counts - left, before + left, mid
            self.path.append((low, high, counts, before))
        return counts, before


def hypergeometric(counts: np.ndarray, number: int, rng: np.random.Generator) -> np.ndarray:
    """``number`` drawn without replacement, source after source; exact at any size."""
    drawn, rest = np.zeros_like(counts), int(counts.sum())
    for i in np.flatnonzero(counts).tolist():
        n = int(counts[i])
        if not number:
            break
        got = int(rng.hypergeometric(n, rest - n, number)) if rest < GENERATOR_RANGE else large_hypergeometric(n, rest - n, number, rng)
        drawn[i] = got
        number, rest = number - got, rest - n
    return drawn


def large_hypergeometric(good: int, bad: int, number: int, rng: np.random.Generator) -> int:
    """One draw beyond the generator's range: rejection under a bound that holds for every log-concave law (Devroye 1987).

    Probabilities are compared through logarithms of factorials of ``DIGITS`` digits, so that nothing is rounded away.
    """
    least, most = max(0, number - bad), min(good, number)
    if least == most:
        return least
    total = good + bad
    mode = min(most, max(least, (number + 1) * (good + 1) // (total + 2)))
    with localcontext() as context:
        context.prec = DIGITS
        parts = lambda k: sum(log_factorial(x) for x in (k, good - k, number - k, bad - number + k))
        at_mode = parts(mode)
        top = sum(log_factorial(x) for x in (good, bad, number, total - number)) - log_factorial(total) - at_mode
        peak = float(top.exp())
        width = 1 + peak / 2
        while True:
            u, v, w, sign = rng.random(), rng.random(), rng.random(), 1 if rng.random() < 0.5 else -1
            y = v * width / peak if u <= width / (1 + width) else (width + rng.exponential()) / peak
            k = mode + sign * int(round(y))
            bound = w * min(1.0, math.exp(width - peak * y))
            if least <= k <= most and (bound == 0 or Decimal(bound).ln() <= at_mode - parts(k)):
                return k


def log_factorial(n: int) -> Decimal:
    """Of the number of digits in force: a sum for small numbers, Stirling's series beyond."""
    if n < 200:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n + 1)
    series = sum(Decimal(a) / (Decimal(b) * x**p) for a, b, p in ((1, 12, 1), (-1, 360, 3), (1, 1260, 5), (-1, 1680, 7), (1, 1188, 9)))
    return (x - Decimal("0.5")) * x.ln() - x + (2 * PI).ln() / 2 + series


def permuted(index: np.ndarray, n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` at ``index``: a Feistel network, walked until it falls below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(list(seed)).integers(1, 2**63, 6, dtype=np.uint64) | np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            mixed = (right + np.uint64(1)) * k
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def slots(spark, catalogue: list[Source], seed: int = 0, per_shard: int = SHARD_SLOTS) -> DataFrame:
    """``(shard, slot, source_no, epoch, block)``: which block every slot of the mix takes."""
    number = [s.slots for s in catalogue]
    blocks = [s.blocks for s in catalogue]
    shards = -(-sum(number) // per_shard)

    def run(batches):
        drawn = ShardCounts(number, shards, per_shard, seed)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = drawn.of(shard)
                which, epoch, block = [], [], []
                for s in np.flatnonzero(counts).tolist():
                    j = np.arange(before[s], before[s] + counts[s])
                    turn, at = j // blocks[s], j % blocks[s]
                    for e in np.unique(turn).tolist():
                        part = at[turn == e]
                        which.append(np.full(len(part), s, dtype=np.int32))
                        epoch.append(np.full(len(part), e, dtype=np.int32))
                        block.append(permuted(part, blocks[s], (seed, s, e)))
                order = np.random.default_rng([seed, shards, shard, 1]).permutation(int(counts.sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(order), shard, dtype=np.int64)), pa.array(np.arange(len(order), dtype=np.int32)),
                        *(pa.array(np.concatenate(x)[order]) for x in (which, epoch, block)),
                    ],
                    names=["shard", "slot", "source_no", "epoch", "block"],
                )

    tasks = max(1, min(shards // 8, 10_000))
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "shard long, slot int, source_no int, epoch int, block long")


def streams(sized: DataFrame, catalogue: list[Source], seed: int = 0) -> DataFrame:
    """``sized`` rows of one word or more with ``source_no``, ``length`` of its blocks, ``begin`` and ``end`` in its stream of words.

    A stream is ordered by a hash of the id. Positions are summed inside hashed buckets and shifted by the
    sums of the buckets before, so no source is ordered in one task.
    """
    spark = sized.sparkSession
    rows = sized.where("size > 0")
    named = spark.createDataFrame(
        pd.DataFrame({"name": [s.name for s in catalogue], "source_no": range(len(catalogue)), "length": [s.block for s in catalogue]})
        .astype({"name": object}),
        "name string, source_no int, length long",
    )
    rows = rows.join(named, rows["source"].eqNullSafe(named["name"])).drop("name")
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "id")).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    inside = Window.partitionBy("source_no", "bucket").orderBy("draw", "id", "size")
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select(
        "source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    summed = rows.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = summed.join(settled(shifts, "shifts").hint("merge"), ["source_no", "bucket"])
    placed = placed.withColumn("end", F.col("end") + F.col("shift"))
    return placed.withColumn("begin", F.col("end") - F.col("size")).drop("draw", "bucket", "shift")


def block_parts(placed: DataFrame) -> DataFrame:
    """``placed`` per block it reaches into: ``block``, ``from_word`` of the document and ``n_words``."""
    sliced = placed.withColumn("block", F.explode(F.sequence(F.expr("begin div length"), F.expr("(end - 1) div length"))))
    first = F.greatest("begin", F.col("block") * F.col("length"))
    last = F.least("end", (F.col("block") + 1) * F.col("length"))
    return sliced.withColumn("from_word", first - F.col("begin")).withColumn("n_words", last - first).drop("length")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(id, size, source, source_size, target, taken)`` per row.

    Null and empty texts hold no words: size and taken are 0. Repeated rows are drawn each on its own. A source
    without words has target 0. An empty table gives no rows.
    """
    rows = settled(sized(docs, id_col, text_col, source_col), "sizes")
    catalogue = sources(rows, block_words)
    placed = streams(rows, catalogue, seed)
    times = slots(rows.sparkSession, catalogue, seed).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    parts = block_parts(placed).join(settled(times, "times"), ["source_no", "block"], "left")
    taken = F.sum(F.col("n_words") * F.coalesce("times", F.lit(0)))
    drawn = parts.groupBy("source_no", "begin", "id", "source", "size").agg(taken.alias("taken"))
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    every = drawn.select("id", "source", "size", "taken").unionByName(none)
    facts = rows.sparkSession.createDataFrame(
        [(s.name, s.size, s.target) for s in catalogue], "name string, source_size long, target double"
    )
    return every.join(facts, every["source"].eqNullSafe(facts["name"])).drop("name")


def mixed_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The mix itself: ``(shard, slot, source_no, epoch, block, id, source, size, begin, from_word, n_words)``."""
    rows = settled(sized(docs, id_col, text_col, source_col), "sizes")
    catalogue = sources(rows, block_words)
    drawn = settled(slots(rows.sparkSession, catalogue, seed), "slots")
    return block_parts(streams(rows, catalogue, seed)).join(drawn, ["source_no", "block"])


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    length_col: str | None = "n_chars", seed: int = 0, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The mix as rows like those of ``docs``: per document and epoch the words taken, in their order.

    A document taken whole keeps its text as it is; of one taken in part the words stay with the white space behind
    them. Twice taken, it gives two rows.
    Rows that share id, source and size follow the first of them. Rows without words are in no mix.
    """
    blocks = mixed_blocks(docs, id_col, text_col, source_col, seed, block_words)
    span = F.struct(F.col("from_word").alias("at"), F.col("n_words").alias("n"))
    by_row = blocks.groupBy("id", "source", "size", "begin", "epoch").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    spans = by_row.groupBy("id", "source", "size", "epoch").agg(F.min(F.struct("begin", "spans")).alias("first"))
    i, s, z, e, p = (unused(docs, x) for x in ("mix_id", "mix_source", "mix_size", "mix_epoch", "mix_spans"))
    spans = settled(
        spans.select(F.col("id").alias(i), F.col("source").alias(s), F.col("size").alias(z), F.col("epoch").alias(e),
                     F.col("first.spans").alias(p)), "spans",
    )
    on = (
        docs[id_col].eqNullSafe(spans[i]) & docs[source_col].cast("string").eqNullSafe(spans[s])
        & (words(docs[text_col]) == spans[z])
    )

    # Runs of words keep the white space behind each word; what ends a text loses it.
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0))
    parts = F.transform(p, lambda part: F.array_join(F.slice(runs, (part["at"] + 1).cast("int"), part["n"].cast("int")), ""))
    text = F.regexp_replace(F.array_join(parts, ""), BLANKS + "\\z", "")
    whole = F.aggregate(p, F.lit(0).cast("long"), lambda acc, part: acc + part["n"]) == F.col(z)
    mixed = docs.join(spans.hint("merge"), on).withColumn(text_col, F.when(whole, F.col(text_col).cast("string")).otherwise(text))
    if length_col in docs.columns:
        mixed = mixed.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return mixed.select(*docs.columns)
