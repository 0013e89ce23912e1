"""Repair of conversation structure: a Viterbi pass over chunks that start from guessed costs (rank convergence)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from guardlake.llm.common import bounded_batches
from guardlake.operators.ordering import join_null_safe
from guardlake.session import settled

#: Rows of a chunk at most, and passes that mend guessed costs before what is left is composed from chunk maps.
CHUNK_ROWS, PASSES = 32_768, 4
#: Characters by which rows of one turn are ordered, their digest deciding beyond.
ORDER_CHARS = 64

# Costs of the edits, and the states of (s?(ua)+)? with the one role that may follow each.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
EMPTY, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("blank", "duplicate", "truncated")

Vector = tuple[int, int, int, int]
#: Costs of ending in each state, insertions included; also the guess that chunks start from.
FINAL: Vector = (0, 10, 5, 0)
_FAR = 1_000_000

_ORDER = ("turn", "role_start", "text_start", "digest", "uid")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` with faults put in by crc32 of ``conv:turn`` modulo 20; nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 gives it twice, 4 makes it the user's.
    """
    word = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    told = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word(text), "[.!?]", "")).otherwise(word(text))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(word(role)).alias("role"), told.alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def step(code: int, after: Vector) -> Vector:
    """Costs before a row from the costs after it. ``code``: the state the row's role leads to, 4 truncated, 8 must go."""
    extra, role = TRUNCATED * (code >> 2 & 1), code & 3
    best = []
    for state in range(4):
        cost = DELETE + after[state]
        if not code & 8:
            cost = min(cost, REROLE + extra + after[NEXT[state]])
            if role and (role == NEXT[state] or role == SYSTEM and state == EMPTY):
                cost = min(cost, extra + after[role])
        best.append(cost)
    return with_inserts(best)


def with_inserts(cost: list[int] | Vector) -> Vector:
    return tuple(min(c, INSERT + cost[NEXT[s]], 2 * INSERT + cost[NEXT[NEXT[s]]]) for s, c in enumerate(cost))


class Trellis:
    """Steps and traced edits remembered by code and costs up to a constant; few of those exist."""

    def __init__(self) -> None:
        self.steps: dict = {}
        self.edits: dict = {}

    def before(self, code: int, after: Vector) -> tuple[Vector, int]:
        """The costs before a row less their least, and that least."""
        known = self.steps.get((code, after))
        if known is None:
            cost = step(code, after)
            known = self.steps[code, after] = tuple(c - min(cost) for c in cost), min(cost)
        return known

    def solve(self, codes: bytes, end: Vector, old: list[Vector] | None = None) -> list[Vector]:
        """Costs up to a constant at every place, from ``end`` backwards.

        With the ``old`` costs of an earlier pass, it stops where both differ by a constant only: the rest holds.
        """
        path = [end] * (len(codes) + 1) if old is None else [*old[:-1], end]
        for i in range(len(codes) - 1, -1, -1):
            cost = self.before(codes[i], path[i + 1])[0]
            if old is not None and cost == old[i]:
                break
            path[i] = cost
        return path

    def map(self, codes: bytes) -> list[int]:
        """Costs at the begin of a chunk from each state at its end: 16 numbers, by end state."""
        out = []
        for state in range(4):
            cost, total = with_inserts([0 if s == state else _FAR for s in range(4)]), 0
            for code in reversed(codes):
                cost, least = self.before(code, cost)
                total += least
            out += [c + total for c in cost]
        return out

    def edit(self, code: int, after: Vector, state: int) -> tuple[str, int]:
        """The ASCII-least cheapest edits up to and of a row, and the state behind it."""
        known = self.edits.get((code, after, state))
        if known is None:
            here, at, letters = step(code, after), state, ""
            extra, role = TRUNCATED * (code >> 2 & 1), code & 3
            while True:
                if DELETE + after[at] == here[at]:
                    letters += "D"
                elif INSERT + here[NEXT[at]] == here[at]:
                    letters, at = letters + "I", NEXT[at]
                    continue
                elif role and (role == NEXT[at] or role == SYSTEM and at == EMPTY) and extra + after[role] == here[at]:
                    letters, at = letters + "K", role
                else:
                    letters, at = letters + "R", NEXT[at]
                break
            known = self.edits[code, after, state] = letters, at
        return known

    def trace(self, codes: bytes, end: Vector, state: int, last: bool) -> tuple[str, int]:
        path, letters = self.solve(codes, end), []
        for i, code in enumerate(codes):
            made, state = self.edit(code, path[i + 1], state)
            letters.append(made)
        while last and state in (SYSTEM, USER):
            letters.append("I")
            state = NEXT[state]
        return "".join(letters), state


def mapped(df: DataFrame, schema: str, make) -> DataFrame:
    """Map-only: ``make()`` gives, once per task, a function from a row's values to a row of ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = [work(*values) for values in zip(*(c.to_pylist() for c in batch.columns))]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def rows_in_order(rows: DataFrame) -> DataFrame:
    """Settled rows with their place in the order, the digest of role and text, and a number of their own."""
    filled = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return settled(
        rows.select(
            "conv", "turn", "role", "text", F.left("role", F.lit(ORDER_CHARS)).alias("role_start"),
            F.left("text", F.lit(ORDER_CHARS)).alias("text_start"), F.sha2(filled.cast("binary"), 256).alias("digest"),
            F.monotonically_increasing_id().alias("uid"), fault_of_text().alias("fault"),
        ),
        "conversation_rows",
    )


def fault_of_text() -> Column:
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    return F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


def codes_of(rows: DataFrame) -> DataFrame:
    """Narrow rows with the fault that counts; a role and text met earlier in the conversation is a duplicate."""
    bare = rows.drop("text")
    told = bare.where(~F.col("fault").eqNullSafe("blank"))
    first = told.groupBy("conv", "digest").agg(F.min(F.struct("turn", "uid")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("conv", "digest", "first")
    met = join_null_safe(bare, settled(first, "first_told"), ["conv", "digest"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn", "uid"))
    fault = F.when(F.col("fault").eqNullSafe("blank"), F.col("fault")).when(again, "duplicate").otherwise(F.col("fault"))
    start = F.left("role", F.lit(1))
    code = F.when(start == "s", SYSTEM).when(start == "u", USER).when(start == "a", ASSISTANT).otherwise(0)
    code = code + F.when(fault == "truncated", 4).when(fault.isNull(), 0).otherwise(8)
    return met.select("conv", *_ORDER, fault.alias("fault"), code.cast("int").alias("code"))


def chunks_of(codes: DataFrame, chunk_rows: int) -> DataFrame:
    """``(conv, <order of the first row>, codes)``: rows ranged by conversation and order, cut where a range ends.

    A conversation of any size spreads over ranges; a chunk holds one byte per row.
    """
    kind = codes.schema["conv"].dataType.simpleString()
    keys = ["conv", *_ORDER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, bytearray()
        for batch in batches:
            types = [f.type for f in batch.schema][:-1]
            out = []
            for *row, code in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and (row[0] != key[0] or len(held) >= chunk_rows):
                    out.append((*key, bytes(held)))
                    key = None
                if key is None:
                    key, held = row, bytearray()
                held.append(code)
            if out:
                yield table_of(out, types)
        if key is not None:
            yield table_of([(*key, bytes(held))], types)

    def table_of(rows: list[tuple], types: list) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), [*types, pa.binary()])]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "codes"])

    schema = f"conv {kind}, turn long, role_start string, text_start string, digest string, uid long, codes binary"
    ranged = codes.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "code")
    return ranged.mapInArrow(run, schema)


def traced(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """``(conv, <order of the first row>, edits)`` for settled chunks.

    A conversation of one chunk is solved where it is. The chunks of a longer one start backwards from guessed costs
    at the same time; passes then rerun those whose follower's first costs are not, up to a constant, what they started from,
    each only until its costs again differ by a constant from the ones it had. Chunks that stay apart after ``passes``
    (costs need not converge where every row goes) get their end costs from maps of 16 numbers per chunk, composed
    per conversation. Edits are traced from every state a chunk may begin in, the states are chained, and the edits of
    the true one kept.
    """
    order = Window.partitionBy("conv").orderBy(*_ORDER)
    places = chunks.select("conv", *_ORDER).select(
        "uid", F.row_number().over(order).alias("place"), F.lead("uid").over(order).alias("follower"),
    )
    placed = chunks.join(settled(places, "chunk_places"), "uid")
    alone = placed.where("place = 1 AND follower IS NULL")
    kind = chunks.schema["conv"].dataType.simpleString()
    keys = f"conv {kind}, turn long, role_start string, text_start string, digest string, uid long"

    def whole():
        trellis = Trellis()
        return lambda *row: (*row[:-1], trellis.trace(row[-1], FINAL, EMPTY, True)[0])

    done = mapped(alone.select("conv", *_ORDER, "codes"), f"{keys}, edits string", whole)
    many = settled(placed.where("place > 1 OR follower IS NOT NULL"), "long_conversations")
    if many.isEmpty():
        return done
    ends = chunk_ends(many, passes)
    follow = settled(many.select("uid", "codes", "follower").join(ends, "uid"), "chunk_costs")

    def exits():
        trellis = Trellis()
        return lambda uid, codes, end: (uid, [trellis.trace(codes, tuple(end), s, False)[1] for s in range(4)])

    moves = mapped(follow.select("uid", "codes", "end"), "uid long, exits array<int>", exits)
    narrow = many.select("conv", "place", "uid").join(moves, "uid")

    def chain(table: pa.Table) -> pa.Table:
        state, at = EMPTY, {}
        for _, uid, exits in sorted(zip(*(table.column(c).to_pylist() for c in ("place", "uid", "exits")))):
            at[uid] = state
            state = exits[state]
        return pa.table({"uid": pa.array(list(at), pa.int64()), "state": pa.array(list(at.values()), pa.int32())})

    states = settled(narrow.groupBy("conv").applyInArrow(chain, "uid long, state int"), "chunk_states")

    def told():
        trellis = Trellis()
        return lambda *row: (*row[:6], trellis.trace(row[6], tuple(row[7]), row[8], row[9] is None)[0])

    rows = many.select("conv", *_ORDER, "codes", "follower").join(ends, "uid").join(states, "uid")
    rows = rows.select("conv", *_ORDER, "codes", "end", "state", "follower")
    return done.unionByName(mapped(rows, f"{keys}, edits string", told))


def chunk_ends(many: DataFrame, passes: int) -> DataFrame:
    """``(uid, end)``: the costs at the end of each chunk, up to a constant."""

    def guess():
        trellis = Trellis()
        return lambda uid, follower, codes: (uid, follower, codes, list(FINAL), flat(trellis.solve(codes, FINAL)))

    def flat(path: list[Vector]) -> bytes:
        return bytes(c for cost in path for c in cost)

    def unflat(path: bytes) -> list[Vector]:
        return list(zip(*[iter(path)] * 4))

    def mend():
        trellis = Trellis()

        def work(uid, follower, codes, end, path, need):
            if need is not None and need != end:
                end, path = need, flat(trellis.solve(codes, tuple(need), unflat(path)))
            return uid, follower, codes, end, path

        return work

    schema = "uid long, follower long, codes binary, end array<int>, path binary"
    solved = settled(mapped(many.select("uid", "follower", "codes"), schema, guess), "chunk_paths")
    first = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.conv(F.hex(F.substring(F.col("path"), i + 1, 1)), 16, 10).cast("int"))
    for again in range(passes + 1):
        begins = solved.select(F.col("uid").alias("follower"), first.alias("need"))
        needs = settled(solved.select("uid", "follower", "end").join(begins, "follower").where("end <> need").select("uid", "need"), "needs")
        if needs.isEmpty():
            return solved.select("uid", "end")
        if again < passes:
            rows = solved.join(needs, "uid", "left").select("uid", "follower", "codes", "end", "path", "need")
            solved = settled(mapped(rows, schema, mend), "chunk_paths")

    def maps():
        trellis = Trellis()
        return lambda uid, codes: (uid, trellis.map(codes))

    summed = mapped(many.select("uid", "codes"), "uid long, costs array<int>", maps)

    def compose(table: pa.Table) -> pa.Table:
        end, ends = list(FINAL), {}
        for _, uid, costs in sorted(zip(*(table.column(c).to_pylist() for c in ("place", "uid", "costs"))), reverse=True):
            ends[uid] = end
            begin = [min(end[t] + costs[4 * t + s] for t in range(4)) for s in range(4)]
            end = [c - min(begin) for c in begin]
        return pa.table({"uid": pa.array(list(ends), pa.int64()), "end": pa.array(list(ends.values()), pa.list_(pa.int32()))})

    narrow = many.select("conv", "place", "uid").join(summed, "uid")
    return settled(narrow.groupBy("conv").applyInArrow(compose, "uid long, end array<int>"), "chunk_ends")


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, passes: int = PASSES) -> DataFrame:
    """``(conv, step, turn, edit, fault, told_role, role, text)``: the cheapest edits that make each conversation legal.

    ``rows`` are ``(conv, turn, role, text)``. A conversation's rows are taken by turn, nulls first; rows of one turn by
    role, text's first characters and digest, so repeated rows are neighbours. ``told_role`` is a row's role before (null
    for an inserted row), ``role`` and ``text`` what it is after (null for a deleted row). Among edits of equal cost
    the ASCII-least letters win. Null conversations are one conversation; an empty table gives no rows. A hot
    conversation is chunked for the costs; its rows pass one task once, as a stream, to be written in order.
    """
    bounded_batches(rows.sparkSession)
    placed = rows_in_order(rows)
    codes = settled(codes_of(placed), "codes")
    edits = traced(settled(chunks_of(codes, chunk_rows), "chunks"), passes)
    keys = ["conv", *_ORDER]
    none = lambda kind: F.lit(None).cast(kind)
    faults = codes.select(F.col("uid").alias("uid_"), F.col("fault").alias("fault_"))
    lines = placed.drop("fault").join(faults, F.col("uid") == F.col("uid_"))
    lines = lines.select(*keys, F.lit(1).alias("kind"), F.col("fault_").alias("fault"), "role", "text", none("string").alias("edits"))
    orders = edits.select(
        *keys, F.lit(0).alias("kind"), none("string").alias("fault"), none("string").alias("role"), none("string").alias("text"), "edits"
    )
    together = lines.unionByName(orders).repartition("conv").sortWithinPartitions(*keys, "kind")
    name = rows.schema["conv"].dataType.simpleString()
    row_edits = re.compile("(I*)([DKR])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, state, left = None, 0, EMPTY, ""
        started = False

        def inserted(count: int) -> Iterator[tuple]:
            nonlocal state, number
            for _ in range(count):
                state = NEXT[state]
                yield conv, number, None, "I", None, None, ROLE_OF[state], ""
                number += 1

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal conv, number, state, left, started
            for own, turn, kind, fault, role, text, edits in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    yield from inserted(len(left))
                    if not started or own != conv:
                        conv, number, state, started = own, 0, EMPTY, True
                    left, at = edits, 0
                    continue
                found = row_edits.match(left)
                yield from inserted(len(found[1]))
                edit, after, left = found[2], (role, text), left[found.end():]
                if edit == "D":
                    after = (None, None)
                elif edit == "R":
                    state = NEXT[state]
                    after = (ROLE_OF[state], text)
                else:
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield conv, number, turn, edit, fault, role, *after
                number += 1

        for batch in batches:
            made = list(rows_of(batch))
            if made:
                yield table_of(made, batch.schema.field(0).type)
        made = list(inserted(len(left)))
        if made:
            yield table_of(made, batch.schema.field(0).type)

    def table_of(made: list[tuple], kind) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.int64(), *[pa.string()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=OUT)

    OUT = ["conv", "step", "turn", "edit", "fault", "told_role", "role", "text"]
    narrow = together.select("conv", "turn", "kind", "fault", "role", "text", "edits")
    return narrow.mapInArrow(
        run, f"conv {name}, step long, turn long, edit string, fault string, told_role string, role string, text string"
    )


def summaries(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations(conv)``: faults, cost, letters of the edits, digest of what is left.

    A conversation without edits has zeros, no letters and the digest of nothing. The edits of a
    conversation pass one task in order, as its digest needs; the task holds its letters, not its texts.
    """
    name = edits.schema["conv"].dataType.simpleString()
    every = conversations.select("conv").distinct()
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in edits.schema if f.name not in ("conv", "step")]
    heads = every.select("conv", F.lit(-1).cast("long").alias("step"), *missing)
    together = edits.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "step")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = now = None

        def closed() -> tuple:
            conv, n, turns, audit, digest, _ = now
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            return conv, gaps, *(n[c] for c in numbers[1:]), "".join(audit), digest.hexdigest()

        def take(turn, edit, fault, told, role, text) -> None:
            _, n, turns, audit, digest, last = now
            audit.append(edit)
            if told is not None:
                if last[0] is not None and (last[0][:1] + told[:1]) not in ("su", "ua", "au"):
                    n["illegal"] += 1
                last[0] = told
                if fault:
                    n[fault] += 1
                if turn is not None and (not turns[2] or turn != turns[1]):
                    turns[:] = [turn if not turns[2] else turns[0], turn, turns[2] + 1]
            n["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            n["cost"] += TRUNCATED if fault == "truncated" and edit != "D" else 0
            if role is not None:
                digest.update((b"\n" if last[1] else b"") + f"{role}:{text}".encode())
                last[1] = True

        def table_of(made: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            names = ["conv", *numbers, "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

        for batch in batches:
            kind, made = batch.schema.field(0).type, []
            for conv, at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at == -1:
                    if now is not None:
                        made.append(closed())
                    now = conv, dict.fromkeys(numbers, 0), [0, 0, 0], [], hashlib.sha256(), [None, False]
                else:
                    take(*row)
            if made:
                yield table_of(made)
        if now is not None:
            yield table_of([closed()])

    schema = f"conv {name}, {', '.join(f'{n} long' for n in numbers)}, audit string, repaired_sha256 string"
    return together.select("conv", "step", "turn", "edit", "fault", "told_role", "role", "text").mapInArrow(run, schema)
