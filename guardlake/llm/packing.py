"""Best-fit packing with matched large items."""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window

from guardlake.llm.common import bounded_batches
from guardlake.session import settled

CAPACITY = 4_096
END_ID = 1
#: Bytes of texts whose ids a task puts together at a time.
SLICE_CHARS = 4_000_000
#: Words whose ids a task remembers; beyond that it forgets them all.
MEMO = 600_000
#: Rows of one ranking bucket, about.
BUCKET_ROWS = 20_000


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, remember: int = MEMO,
) -> DataFrame:
    """``(id, piece, start, length, ids)``: each text's ids and ``end_id``, cut at ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers, as binary.

    Null and empty texts are the end id alone. The tokenizer must map stretches between ASCII white space
    independently of each other (its rules neither cross nor keep white space), and a word independently of marks behind it and
    of ASCII case; one that does not raises an error. So each distinct stretch is looked at once and remembered
    (``remember`` of them at a time), and the ids of a text are gathered from those of its words. A text over
    ``capacity`` becomes whole pieces and a shorter last one.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer, end_id, remember)
        for batch in batches:
            for part in slices_of(batch):
                data, lengths = words.ids_of(part.column(1).fill_null(""))
                number = -(-lengths // capacity)
                text = np.repeat(np.arange(len(lengths)), number)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
                length = np.minimum(capacity, lengths[text] - piece * capacity)
                ends = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(ends), data])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity),
                        pa.array(length), ids,
                    ],
                    names=["id", "piece", "start", "length", "ids"],
                )
                del data, ids
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids binary")


def slices_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_CHARS`` bytes of text each, or one longer row."""
    held = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        before = held[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(held, before + SLICE_CHARS, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Token ids of texts from those of their words, each distinct word learnt once.

    A text is cut at white space; a stretch is a word and the marks behind it. A slice of texts is handled by its distinct
    stretches: Arrow strips and folds them, and gathers the ids, as bytes, by their numbers.
    """

    #: Marks that stand by themselves behind a letter or digit, and the letters meant.
    MARKS, LETTERS = ".,!?;:*$%&#", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"

    def __init__(self, tokenizer: str, end_id: int, remember: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.model, self.remember = Tokenizer.from_file(tokenizer), remember
        self.end, self.word = np.array([end_id], dtype="<u4").tobytes(), re.compile(f"[{self.LETTERS}]+")
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        own = lambda text: self.model.encode(text, add_special_tokens=False).ids
        for text, parts in (("ab cd\n ef", ("ab", "cd", "ef")), ("Grand!,", ("grand", "!,")), ("x9;", ("x9", ";"))):
            if own(text) != [i for p in parts for i in own(p)] or not self.last[own(parts[0])[-1]]:
                raise ValueError(f"{tokenizer} does not treat words, marks and white space apart")

    def ids_of_units(self, units: list[str]) -> pa.Array:
        """Ids of words or marks. Words of letters are learnt many at a time, as each ends with its one token that ends a
        word; the rest singly."""
        known = self.known
        new = [w for w in units if w not in known]
        if len(known) + len(new) > self.remember:
            known.clear()
            new = units
        plain = [w for w in new if self.word.fullmatch(w)]
        rest = [w for w in new if not self.word.fullmatch(w)]
        for begin in range(0, len(plain), 65_536):
            part = plain[begin : begin + 65_536]
            lines = [" ".join(part[i : i + 64]) for i in range(0, len(part), 64)]
            ids = np.array([i for c in self.model.encode_batch_fast(lines, add_special_tokens=False) for i in c.ids], dtype="<u4")
            stops = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            known.update(zip(part, [data[a:b] for a, b in zip([0, *stops[:-1]], stops)]))
        for w, code in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = np.array(code.ids, dtype="<u4").tobytes()
        return pa.array(list(map(known.__getitem__, units)), pa.binary())

    def ids_of_stretches(self, stretches: pa.Array) -> pa.Array:
        words = pc.utf8_rtrim(stretches, characters=self.MARKS)
        behind = pc.binary_length(stretches).to_numpy() - pc.binary_length(words).to_numpy()
        apart, marked = np.zeros(len(stretches), bool), np.flatnonzero(behind)
        before = pc.utf8_slice_codeunits(words.take(pa.array(marked)), -1, 2**31 - 1)
        apart[marked] = pc.match_substring_regex(before, f"[0-9{self.LETTERS}]").to_numpy(zero_copy_only=False)
        words = pc.if_else(pa.array(apart), words, stretches)
        words = pc.if_else(pc.ascii_is_alnum(words), pc.ascii_lower(words), words).dictionary_encode()
        marks, number = np.zeros(len(stretches), np.int32), {"": 0}
        for n in np.unique(behind[apart]).tolist():
            at = np.flatnonzero(apart & (behind == n))
            found = pc.utf8_slice_codeunits(stretches.take(pa.array(at)), -n, 2**31 - 1).dictionary_encode()
            own = np.array([number.setdefault(m, len(number)) for m in found.dictionary.to_pylist()], np.int32)
            marks[at] = own[found.indices.to_numpy()]
        words = self.ids_of_units(words.dictionary.to_pylist()).take(words.indices)
        return pc.binary_join_element_wise(words, self.ids_of_units(list(number)).take(pa.array(marks)), b"")

    def ids_of(self, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts one after the other, an end id behind each, and their numbers."""
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        named = split.flatten().dictionary_encode()
        ids = pa.concat_arrays([self.ids_of_stretches(named.dictionary), pa.array([self.end], pa.binary())])
        told = ids.take(pa.array(np.insert(named.indices.to_numpy(), ends, len(ids) - 1)))
        _, offsets, data = told.buffers()
        stops = np.frombuffer(offsets, np.int32)[: len(told) + 1][ends + np.arange(1, len(ends) + 1)].astype(np.int64)
        return data, np.diff(stops, prepend=0) // 4


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, ...]], int]:
    """Runs ``(length, first rank, bin, items per bin, offset)`` for ``counts`` items of each length, and the bins.

    Only the histogram of lengths enters, so the plan is bounded by ``capacity`` at any number of items. Lengths
    above a third of the capacity come first: at most two of them share a bin, each largest with the largest that still
    fits beside it. The smaller ones follow by falling length, each to the bin with the tightest gap, else to a new
    bin. Bins in the same state are handled as ranges.
    """
    runs: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    taken = dict.fromkeys(counts, 0)
    bins = 0

    def free(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    def put(length: int, first: int, n: int, per_bin: int, offset: int) -> None:
        runs.append((length, taken[length], first, per_bin, offset))
        taken[length] += n

    large = sorted(n for n in counts if 3 * n > capacity)
    left = {n: counts[n] for n in large}
    for n in reversed(large):
        while left[n]:
            at = bisect_left(large, capacity - n + 1) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            other = large[at] if at >= 0 and large[at] <= n else None
            if other is None or (other == n and left[n] == 1):
                number = left[n] if other is None else 1
                put(n, bins, number, 1, 0)
                free(capacity - n, bins, number)
                left[n] -= number
            else:
                number = left[n] // 2 if other == n else min(left[n], left[other])
                put(n, bins, number, 1, 0)
                put(other, bins, number, 1, n)
                free(capacity - n - other, bins, number)
                left[n] -= number
                left[other] -= number
            bins += number
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        rest = counts[n]
        while rest:
            at = bisect_left(order, n)
            if at == len(order):
                per_bin = capacity // n
                number = -(-rest // per_bin)
                free(capacity, bins, number)
                bins += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per_bin = gap // n
            full = min(number, rest // per_bin)
            if full:
                put(n, first, full * per_bin, per_bin, capacity - gap)
                free(gap - per_bin * n, first, full)
                rest -= full * per_bin
                first, number = first + full, number - full
            if number and rest:
                put(n, first, rest, per_bin, capacity - gap)
                free(gap - rest * n, first, 1)
                rest, first, number = 0, first + 1, number - 1
            free(gap, first, number)
    return runs, bins


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items(id, piece, length, ...)`` with ``sequence_id`` and ``offset``; no sequence exceeds ``capacity``.

    The driver sees the histogram of lengths (at most ``capacity`` rows) and sends back the plan. An item finds its
    place by its rank among items of its length: ranked inside hashed buckets, so that a length of many items is
    spread, and shifted by the counts of the buckets before. Ties and repeated rows take places of their own.
    ``items`` must be settled: it is read several times.
    """
    spark = items.sparkSession
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = packing_plan(counts, capacity)
    runs.sort()
    plan = np.array(runs, dtype=np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast(plan)
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    held = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    starts = settled(starts, "rank_starts")
    ranked = held.withColumn("rank", F.row_number().over(inside) - 1).join(starts.hint("merge"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("shift"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = plan.value
        n, r = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        run = table[np.searchsorted(table[:, 0] << 42 | table[:, 1], n << 42 | r, side="right") - 1]
        nth = r - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + nth // run[:, 3], "offset": run[:, 4] + nth % run[:, 3] * n})

    return ranked.withColumn("at", placed("length", "rank")).select(*items.columns, "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed token ids of each sequence, in order of their offsets."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: p.ids), "")).alias("ids")
    )


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    remember: int = MEMO,
) -> DataFrame:
    """Every piece of every text with its ids and its place in a sequence. An empty table gives no rows."""
    return place(settled(pieces(docs, tokenizer, id_col, text_col, capacity, remember=remember), "pieces"), capacity)
