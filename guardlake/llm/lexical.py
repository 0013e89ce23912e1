"""Ranked lexical search over norm buckets of impact vectors (LEMP)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from guardlake.llm.common import bounded_batches
from guardlake.session import settled

#: Terms of the items that are searched together: what a task holds of the query side.
BLOCK_TERMS = 500_000
#: Vectors of a norm bucket (an Arrow batch holds as many); the longest of all, that give every item a score to start from.
BUCKET_ROWS, SEED_ROWS = 1_000, 4_096
#: Heaviest coordinates of an item that bound its products inside a bucket.
FOCUS = 6
#: Bytes of a text that are cut into words at a time.
PART_BYTES = 1 << 20
#: Doubles bound the integer scores; this much is added to a bound before it may rule a vector out.
SLACK = 1e-9

# Letters A-Z fold, digits and bytes of other characters stay, every other ASCII character ends a term.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of a bounded size."""
    folded = (text or b"").translate(_FOLD)
    begin = 0
    while begin < len(folded):
        end = folded.find(b" ", begin + PART_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[begin:end].split()
        begin = end


class Block:
    """Items searched together: their terms numbered, each item an array of term numbers."""

    def __init__(self, terms_of_items: list[list[bytes]]) -> None:
        self.number = {t: i for i, t in enumerate(sorted({t for terms in terms_of_items for t in terms}))}
        self.items = [np.array([self.number[t] for t in terms], dtype=np.int64) for terms in terms_of_items]
        self.weight = np.zeros(len(self.number), dtype=np.int64)

    def weigh(self, n_documents: int, documents_with: dict[int, int]) -> None:
        """Weights of the terms; the coordinates of an item then fall in weight, those without weight go."""
        for i, df in documents_with.items():
            self.weight[i] = int(np.floor(1000 * np.log((2 * n_documents + 2) / (2 * df + 1))))
        self.items = [t[np.argsort(-self.weight[t], kind="stable")] for t in self.items]
        self.items = [t[self.weight[t] > 0] for t in self.items]
        self.length = np.array([np.sqrt(self.weight[t].sum()) for t in self.items])
        self.rest = [np.sqrt(self.weight[t[FOCUS:]].sum()) for t in self.items]


def postings(docs: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """``(id, n, terms, tf)`` per row: its count of terms, and of the numbered terms it holds their occurrences."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, terms, tf, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                counts, n = Counter(), 0
                for part in words(text):
                    n += len(part)
                    counts.update(part)
                held = counts.keys() & known.keys()
                sizes.append(n)
                terms += map(known.__getitem__, held)
                tf += map(counts.__getitem__, held)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, tf array<int>")


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list begins and the last one ends."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), (offsets - offsets[0]).astype(np.int64)


def impact_vectors(rows: DataFrame, weight: np.ndarray, n_documents: int, n_terms: int) -> DataFrame:
    """``(id, norm, salt, terms, impacts)``: a row's integer impacts, and the length of its vector.

    A coordinate is the impact times the root of the term's weight, so that its product with an item, whose coordinates
    are those roots, is the score. ``salt`` numbers the rows of a task: equal lengths then spread over ranges.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        done = 0
        for batch in batches:
            terms, ends = flat(batch.column(2))
            tf, _ = flat(batch.column(3))
            sizes = np.diff(ends)
            row = np.repeat(np.arange(len(sizes)), sizes)
            m = np.array([10 + 90 * n * n_documents // n_terms for n in batch.column(1).to_pylist()], dtype=np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            used = (w[terms] > 0) & (impact > 0)
            terms, impact, row = terms[used], impact[used], row[used]
            square = np.bincount(row, weights=w[terms] * impact.astype(float) ** 2, minlength=len(sizes))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.sqrt(square)), pa.array(np.arange(done, done + len(sizes), dtype=np.int64)),
                    *[pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (terms, impact)],
                ],
                names=["id", "norm", "salt", "terms", "impacts"],
            )
            done += len(sizes)

    made = rows.where(F.size("terms") > 0).select("id", "n", "terms", "tf")
    return made.mapInArrow(run, "id long, norm double, salt long, terms array<int>, impacts array<int>").where("norm > 0")


class Bucket:
    """Vectors of like length: ids, lengths, and for each term its rows and their impacts."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        ids = batch.column(0)
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.norm = batch.column(1).to_numpy()
        self.longest = self.norm.max()
        terms, ends = flat(batch.column(2))
        impact, _ = flat(batch.column(3))
        order = np.argsort(terms, kind="stable")
        self.row = np.repeat(np.arange(len(self.norm)), np.diff(ends))[order]
        self.impact = impact[order]
        self.term = terms[order]

    def of(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        begin, end = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, side="right")
        return [(self.row[b:e], self.impact[b:e]) for b, e in zip(begin.tolist(), end.tolist())]


class Found:
    """The best k rows so far of each item: scores falling, equal scores by rising id, rows without an id last."""

    def __init__(self, k: int, start: np.ndarray) -> None:
        self.k, self.kth = k, start.copy()
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in start]

    def offer(self, item: int, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        score, no_id, ids = (np.concatenate(pair) for pair in zip(self.rows[item], (score, no_id, ids)))
        best = np.lexsort((ids, no_id, -score))[: self.k]
        self.rows[item] = score[best], no_id[best], ids[best]
        if len(best) == self.k:
            self.kth[item] = max(self.kth[item], score[best[-1]])


def search_bucket(block: Block, bucket: Bucket, live: list[int], found: Found) -> list[int]:
    """Offers the bucket's rows to the items in ``live``; gives those items that shorter vectors can still serve.

    An item leaves when its length times the bucket's greatest is below its kth score (Cauchy-Schwarz). Inside,
    the product over its heaviest coordinates, plus the rest of its length times the rest of the vector's, bounds each
    row. Rows that reach the kth score are scored in integers.
    """
    stay = []
    for item in live:
        least = found.kth[item]
        if block.length[item] * bucket.longest * (1 + SLACK) < least:
            continue
        stay.append(item)
        lists = bucket.of(block.items[item])
        weights = block.weight[block.items[item]].tolist()
        product, square = np.zeros(len(bucket.norm)), bucket.norm**2
        for w, (rows, impacts) in zip(weights[:FOCUS], lists):
            product[rows] += w * impacts
            square[rows] -= w * impacts.astype(float) ** 2
        left = np.sqrt(np.maximum(square, 0) + SLACK * bucket.norm**2)
        alive = (product + block.rest[item] * left) * (1 + SLACK) >= least
        if not alive.any():
            continue
        score = np.zeros(len(bucket.norm), dtype=np.int64)
        for w, (rows, impacts) in zip(weights, lists):
            score[rows] += w * impacts
        hit = np.flatnonzero(alive & (score >= least))
        if len(hit):
            found.offer(item, score[hit], bucket.no_id[hit], bucket.id[hit])
    return stay


def sweep(vectors: DataFrame, shared, k: int, start: np.ndarray) -> DataFrame:
    """``(item, id, score)``: each task's best k rows of each item; vectors come to a task by falling length."""
    begin = vectors.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = shared.value, Found(k, begin.value)
        live = [i for i, terms in enumerate(block.items) if len(terms)]
        for batch in batches:
            for first in range(0, batch.num_rows, BUCKET_ROWS):
                if live:
                    live = search_bucket(block, Bucket(batch.slice(first, BUCKET_ROWS)), live, found)
        number = np.array([len(s) for s, _, _ in found.rows])
        score, no_id, ids = (np.concatenate(column) for column in zip(*found.rows))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(number), dtype=np.int32), number)),
                pa.array(ids, mask=no_id), pa.array(score),
            ],
            names=["item", "id", "score"],
        )

    rows = vectors.select("id", "norm", "terms", "impacts")
    return rows.mapInArrow(run, "item int, id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k highest-scoring rows with a score above 0.

    Every row counts as a document of its own, repeated rows too; ids are whole numbers, a null id ranks last among
    equal scores. Null and empty texts hold no term. Repeated items are answered once; different texts under one
    id are items of their own. Without documents, terms or matches there are no rows.

    Items go in blocks of about ``block_terms`` terms. Of every text, read whole, the numbered terms are kept; document
    counts come from all rows. Vectors are ordered by falling length over the whole table, so that a task holds buckets of
    like length; the longest ones give each item a kth score that every task starts from. Only rows of number and
    size bounded by a block reach the driver.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("name"), F.col(item_text).cast("string").cast("binary").alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(dict.fromkeys(w for part in words(t) for w in part)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["name", "terms"])

    kind = items.schema[item_col].dataType.simpleString()
    asked = settled(asked.mapInArrow(run, f"name {kind}, terms array<binary>").where(F.size("terms") > 0), "items")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("name", "terms"), F.lit(blocks)))
    out = spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    for number in range(blocks):
        rows = asked.where(F.col("block") == number).select("name", "terms").collect()
        if rows:
            block = Block([[bytes(t) for t in r.terms] for r in rows])
            best = search(settled(postings(docs, id_col, text_col, block.number), "postings"), block, k)
            names = spark.createDataFrame([(i, r.name) for i, r in enumerate(rows)], f"item int, {item_col} {kind}")
            best = best.join(names, "item").select(item_col, "rank", F.col("id").alias(id_col), "score")
            out = out.unionByName(best)
    return out


def search(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """``(item, rank, id, score)`` of a block's items over settled postings."""
    spark = rows.sparkSession
    totals = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    if not totals.documents:
        return spark.createDataFrame([], "item int, rank int, id long, score long")
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    block.weigh(totals.documents, {r.term: r.n for r in held.collect()})
    vectors = settled(impact_vectors(rows, block.weight, totals.documents, totals.terms), "impacts")
    shared = spark.sparkContext.broadcast(block)
    start = np.ones(len(block.items), dtype=np.int64)
    for r in best_of(sweep(longest(vectors), shared, k, start), k).where(F.col("rank") == k).collect():
        start[r.item] = r.score
    ordered = vectors.repartitionByRange(F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm"), "salt")
    return settled(best_of(sweep(ordered, shared, k, start), k), "answers")


def longest(vectors: DataFrame) -> DataFrame:
    """About ``SEED_ROWS`` of the longest vectors, by falling length inside each task.

    Lengths are counted by eighths of a power of two. Of the levels that reach the number together, an even share by
    salt is taken where one level alone holds many: any rows serve as a start.
    """
    level = F.floor(F.log2("norm") * 8).cast("int")
    counts = vectors.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    total = least = 0
    for r in sorted(counts, key=lambda r: -r.level):
        if total < SEED_ROWS:
            total, least = total + r.n, r.level
    some = vectors.where((F.col("norm") >= 2.0 ** (least / 8)) & (F.col("salt") % max(1, total // SEED_ROWS) == 0))
    return some.sortWithinPartitions(F.desc("norm"), "salt")


def best_of(rows: DataFrame, k: int) -> DataFrame:
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = rows.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)
    return best.select("item", "rank", "id", "score")
