"""Leak tests: does a text hold a secret, or the secret reversed?"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from guardlake.functions import text as tx
from guardlake.session import settled

# Inline secrets are configuration and become part of the plan; longer lists belong in a table.
MAX_INLINE_SECRETS = 1000
# A secret meets texts by one of its windows of so many bytes, the rarest by a sketch of so many counts (a power of two).
WINDOW, SLOTS = 4, 1 << 20
# A text that lacks one of these that every secret has cannot hold any.
MARKS = tuple("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
# Bytes of text stretches that a task hands on at a time, and of texts that it cuts into windows at a time.
PIECE_BYTES, CUT_BYTES = 8 << 20, 1 << 20


def holds_secret(col: Column, secrets: Sequence[str]) -> Column:
    """Case-sensitive containment of any secret of a short fixed list, forwards or reversed."""
    if len(secrets) > MAX_INLINE_SECRETS:
        raise ValueError("pass a long secret list as a DataFrame to leaked()")
    forms = sorted({form for secret in secrets for form in (secret, secret[::-1])})
    hit = F.lit(False)
    for form in forms:
        hit = hit | F.contains(col, F.lit(form))
    return F.coalesce(hit, F.lit(False))


def secret_forms(secrets: DataFrame, column: str) -> DataFrame:
    """Each distinct secret in both reading directions."""
    return (
        secrets.where(F.col(column).isNotNull())
        .select(F.explode(F.array(F.col(column), F.reverse(column))).alias("_secret"))
        .distinct()
    )


def leaked(df: DataFrame, id_cols: str | Sequence[str], texts: Sequence[str], secrets: DataFrame, secret: str) -> DataFrame:
    """Ids of rows that hold a secret, with one boolean per text column; other ids are absent.

    Secrets may be of any number, length and shape; null and empty ones match nothing, nor do null texts. Containment is
    an equi-join: each distinct secret, in both directions, is anchored at the one of its windows of ``WINDOW``
    bytes that a frequency sketch of the windows of the first text column calls rarest. One scan of the texts finds the places of possible
    anchors and passes on the stretch around each that its secrets can cover, so texts themselves never
    travel. Secrets shorter than a window are looked up in tables of all strings of their length.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    forms = settled(secret_forms(secrets, secret).where(F.length("_secret") > 0), "secrets")
    number, n_short, *with_mark = forms.agg(
        F.count(F.lit(1)), F.count_if(_is_short()), *[F.count_if(F.contains("_secret", F.lit(m))) for m in MARKS]
    ).first()
    marks = [m for m, n in zip(MARKS, with_mark) if number and n == number]
    # A cheap test before any window is cut: a mark that every secret holds (an @, say) must be in the text.
    possible = lambda text: reduce(and_, [F.contains(text, F.lit(m)) for m in marks], text.isNotNull())
    flags = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(name).alias("_text")) for i, name in enumerate(texts)])
    flat = df.select(*ids, F.explode(flags).alias("_v")).select(*ids, "_v.*").where(possible(F.col("_text")))
    flat = flat.select(*ids, "_which", F.col("_text").cast("binary").alias("_text"))
    first = df.where(possible(F.col(texts[0]))).select(F.col(texts[0]).cast("binary").alias("_text"))
    whole = forms.where(~_is_short()).select(F.col("_secret").cast("binary").alias("_secret"))
    tables = _short_tables(forms.where(_is_short())) if n_short else {}
    anchors = settled(anchored(whole, window_counts(first, whole)), "anchors")
    hits = pieces_at(flat, [*ids, "_which"], anchors, tables)
    known = anchors.select(F.col("_anchor").alias("_gram"), "_secret")
    met = hits.join(known, "_gram", "left").where((F.col("_gram") < 0) | F.contains("_piece", "_secret"))
    return met.groupBy(*ids).agg(*[F.max(F.col("_which") == i).alias(name) for i, name in enumerate(texts)])


def _is_short() -> Column:
    return F.octet_length("_secret") < WINDOW


def _windows():
    """A function for tasks, of the bytes of a binary Arrow column: its windows of ``WINDOW`` bytes that lie in one row.

    Yields their places, values and slots of the sketch, for a bounded number of bytes at a time; ``bytes_of`` gives
    where rows begin and the bytes.
    """
    width, shift, step = WINDOW, 32 - (SLOTS.bit_length() - 1), CUT_BYTES

    def bytes_of(column):
        column = column.fill_null(b"")
        if not len(column):
            return np.zeros(1, np.int64), b""
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return ends - ends[0], data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""

    def windows(ends, data):
        byte = np.frombuffer(data, np.uint8)
        for begin in range(0, max(0, len(byte) - width + 1), step):
            part = byte[begin : begin + step + width - 1]
            value = np.zeros(len(part) - width + 1, np.uint32)
            for i in range(width):
                value = value << np.uint32(8) | part[i : len(value) + i]
            inside = np.ones(len(value), bool)
            some = ends[np.searchsorted(ends, begin) : np.searchsorted(ends, begin + len(part))] - begin
            for back in range(1, width):
                crossing = some - back
                inside[crossing[(crossing >= 0) & (crossing < len(value))]] = False
            at = np.flatnonzero(inside)
            value = value[at]
            yield at + begin, value, ((value * np.uint32(0x9E3779B1)) >> np.uint32(shift)).astype(np.int64)

    return bytes_of, windows


def window_counts(texts: DataFrame, secrets: DataFrame) -> DataFrame:
    """``(slot, n)``: a sketch of how often the texts hold the windows of secrets, by slot; at most ``SLOTS`` rows.

    Windows that share a slot count together, which may only make an anchor look more frequent than it is. Each
    task adds up its own counts.
    """
    (bytes_of, windows), slots = _windows(), SLOTS

    def named(batches):
        seen = np.zeros(slots, bool)
        for batch in batches:
            for _, _, slot in windows(*bytes_of(batch.column(0))):
                seen[slot] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["slot"])

    wanted = np.zeros(slots, bool)
    wanted[[r.slot for r in secrets.select("_secret").mapInArrow(named, "slot long").distinct().collect()]] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def counted(batches):
        wanted, total = np.unpackbits(shared.value).astype(bool), np.zeros(slots, np.int64)
        for batch in batches:
            for _, _, slot in windows(*bytes_of(batch.column(0))):
                total += np.bincount(slot[wanted[slot]], minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    if not wanted.any():
        return texts.sparkSession.createDataFrame([], "slot long, n long")
    parts = texts.select("_text").mapInArrow(counted, "slot long, n long")
    return parts.groupBy("slot").agg(F.sum("n").alias("n"))


def anchored(secrets: DataFrame, counts: DataFrame) -> DataFrame:
    """``(_secret, _anchor, _slot, _before, _after)``: each secret's rarest window and the bytes from its begin to either end.

    Among equally rare windows the first is taken. ``counts`` has at most ``SLOTS`` rows.
    """
    table = np.zeros(SLOTS, np.int64)
    for r in counts.collect():
        table[r.slot] = r.n
    shared, (bytes_of, windows) = secrets.sparkSession.sparkContext.broadcast(table), _windows()

    def pick(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                secret = batch.column(0).slice(begin, 256)
                ends, data = bytes_of(secret)
                found = list(windows(ends, data))
                if not found:
                    continue
                place, value, slot = (np.concatenate(c) for c in zip(*found))
                row = np.searchsorted(ends, place, side="right") - 1
                order = np.lexsort((place, shared.value[slot], row))
                first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                before = place[first] - ends[row[first]]
                after = ends[row[first] + 1] - place[first]
                numbers = [value[first].astype(np.int64), slot[first], before, after]
                yield pa.RecordBatch.from_arrays(
                    [secret.take(pa.array(row[first])), *[pa.array(v) for v in numbers]],
                    names=["_secret", "_anchor", "_slot", "_before", "_after"],
                )

    return secrets.select("_secret").mapInArrow(
        pick, "_secret binary, _anchor long, _slot long, _before long, _after long"
    )


def _short_tables(short: DataFrame) -> dict[int, bytes]:
    """For each length below ``WINDOW`` in use, one bit for every string of so many bytes: 2 MB at most."""
    found: dict[int, list[int]] = {}
    for r in short.select(F.col("_secret").cast("binary").alias("s")).collect():  # at most 2^24 strings of three bytes
        found.setdefault(len(r.s), []).append(int.from_bytes(r.s, "big"))
    tables = {}
    for width, values in found.items():
        bits = np.zeros(256**width, bool)
        bits[values] = True
        tables[width] = np.packbits(bits).tobytes()
    return tables


def pieces_at(texts: DataFrame, keys: Sequence[str], anchors: DataFrame, tables: dict[int, bytes]) -> DataFrame:
    """``(keys, _gram, _piece)``: for every possible anchor of a text the stretches around it that its secrets can cover.

    Stretches of one anchor in one text are merged where they meet, so together they are no longer than the text. A
    text that holds a secret shorter than a window gives a row with ``_gram`` -1 instead.
    """
    reach = np.zeros((2, SLOTS), np.int64)
    widest = anchors.groupBy("_slot").agg(F.max("_before").alias("before"), F.max("_after").alias("after"))
    for r in widest.collect():  # at most SLOTS rows
        reach[:, r["_slot"]] = r.before, r.after
    shared = texts.sparkSession.sparkContext.broadcast((reach, tables))
    (bytes_of, windows), n_keys, bytes_out, step = _windows(), len(keys), PIECE_BYTES, CUT_BYTES

    def run(batches):
        (before, after), tables = shared.value
        short = {w: np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool) for w, bits in tables.items()}
        for batch in batches:
            ends, data = bytes_of(batch.column(n_keys))
            rows, grams, pieces, size = [], [], [], 0

            def out():
                at = pa.array(rows, pa.int64())
                kept = [batch.column(i).take(at) for i in range(n_keys)]
                return pa.RecordBatch.from_arrays(
                    [*kept, pa.array(grams, pa.int64()), pa.array(pieces, pa.binary())], names=[*keys, "_gram", "_piece"]
                )

            byte = np.frombuffer(data, np.uint8)
            held_short = np.zeros(batch.num_rows, bool)
            for width, bits in short.items():
                for begin in range(0, max(0, len(byte) - width + 1), step):
                    part = byte[begin : begin + step + width - 1]
                    code = np.zeros(len(part) - width + 1, np.int64)
                    for i in range(width):
                        code = code << 8 | part[i : len(code) + i]
                    at = np.flatnonzero(bits[code]) + begin
                    row = np.searchsorted(ends, at, side="right") - 1
                    held_short[row[at + width <= ends[row + 1]]] = True
            for r in np.flatnonzero(held_short).tolist():
                rows.append(r), grams.append(-1), pieces.append(None)
            found = [[], [], []]
            for place, value, slot in windows(ends, data):
                hit = np.flatnonzero(after[slot] > 0)
                for column, values in zip(found, (place[hit], value[hit].astype(np.int64), slot[hit])):
                    column.append(values)
            place, value, slot = (np.concatenate([np.zeros(0, np.int64), *c]) for c in found)
            row = np.searchsorted(ends, place, side="right") - 1
            order = np.lexsort((place, value, row))
            begin = np.maximum(place - before[slot], ends[row])[order].tolist()
            end = np.minimum(place + after[slot], ends[row + 1])[order].tolist()
            held = None
            for r, g, b, e in [*zip(row[order].tolist(), value[order].tolist(), begin, end), (-1, 0, 0, 0)]:
                if held is not None and held[0] == r and held[1] == g and b <= held[3]:
                    held[3] = max(held[3], e)
                    continue
                if held is not None:
                    rows.append(held[0]), grams.append(held[1]), pieces.append(data[held[2] : held[3]])
                    size += held[3] - held[2]
                    if size > bytes_out:
                        yield out()
                        rows, grams, pieces, size = [], [], [], 0
                held = [r, g, b, e]
            if rows:
                yield out()

    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys)
    return texts.select(*keys, "_text").mapInArrow(run, f"{fields}, _gram long, _piece binary")


def distinct_addresses(df: DataFrame, text: str, name: str = "email") -> DataFrame:
    """The distinct addresses a corpus holds: usable as its secret table."""
    values = F.explode(tx.entity_values(F.col(text), tx.EMAIL_ADDRESS)).alias(name)
    return df.where(F.contains(F.col(text), F.lit("@"))).select(values).distinct()


def exact_guess(text: Column, secrets: Sequence[str]) -> Column:
    """The whole text equals one of a short secret list: no trim, no case fold."""
    return F.coalesce(text.isin(*secrets), F.lit(False)) if secrets else F.lit(False)


def with_exact_guess(
    turns: DataFrame, level: str, text: str, secrets: DataFrame, secret: str, name: str = "correct"
) -> DataFrame:
    """Exact guess against a secret table keyed by level. Each turn meets at most one secret row."""
    known = secrets.select(F.col(level).alias("_level"), F.col(secret).alias("_secret")).distinct()
    known = known.withColumn("_hit", F.lit(True))
    joined = turns.join(known, (turns[level] == known["_level"]) & (turns[text] == known["_secret"]), "left")
    return joined.withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_level", "_secret", "_hit")
