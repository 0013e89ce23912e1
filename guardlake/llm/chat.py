"""Chat formatting from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

#: Marks of the template, and what stands for them inside texts; the escape sign itself is doubled.
BEGIN, END, ESCAPE = "### ", "</turn>\n", "\\"
ESCAPED = ((ESCAPE, ESCAPE * 2), ("###", ESCAPE + "h"), ("</turn>", ESCAPE + "e"), (":", ESCAPE + "c"))
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    """Text in which no mark occurs; a role has no colon either. ``unescape`` gives the text back."""
    for sign, stand_in in ESCAPED if role else ESCAPED[:-1]:
        text = F.replace(text, F.lit(sign), F.lit(stand_in))
    return text


def unescape(text: Column) -> Column:
    """Doubled escape signs split the text, so those left in the parts each begin a stand-in."""

    def plain(part: Column) -> Column:
        for sign, stand_in in ESCAPED[1:]:
            part = F.replace(part, F.lit(stand_in), F.lit(sign))
        return part

    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), plain), ESCAPE)


def final_messages(log: DataFrame) -> DataFrame:
    """``(conv_id, message, role, text)`` from ``log(conv_id, seq, message, kind, role, text)``.

    Events of a conversation apply in order of ``seq`` (ties by kind, then text): ``open`` begins a message with its
    role, ``delta`` appends text, ``edit`` replaces the text so far, ``regenerate`` empties it and drops all that was told of
    messages of higher number before it; what is opened again under such a number after it stays. Texts that are null
    append nothing; a message without an ``open`` that holds has no role (empty). ``message`` and ``seq`` may be of any
    type with an order. Messages are folded each on its own, so only what is left of a long conversation meets in one place.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    folded = log.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(event)).alias("events"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    dropped = folded.withColumn("dropped_at", F.max("again").over(before))
    held = F.filter("events", lambda e: F.col("dropped_at").isNull() | (e.seq > F.col("dropped_at")))
    left = dropped.withColumn("events", held).where(F.size("events") > 0)
    last = lambda *kinds: F.try_element_at(F.filter("events", lambda e: e.kind.isin(*kinds)), F.lit(-1))
    left = left.select("conv_id", "message", "events", last("edit", "regenerate").alias("reset"), last("open").alias("opened"))
    kept = F.filter(
        "events",
        lambda e: e.kind.isin("delta", "edit")
        & (F.col("reset").isNull() | (F.struct(e.seq, e.kind) >= F.struct(F.col("reset.seq"), F.col("reset.kind")))),
    )
    text = F.array_join(F.transform(kept, lambda e: e.text), "")
    return left.select("conv_id", "message", F.coalesce("opened.role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, segments)``: the formatted conversation as ``array<struct<text, loss>>``, in order.

    A turn is ``### role: text</turn>`` and a line break; only an assistant's text carries loss. The whole output is the
    segments' texts one after another. One row holds one conversation, which is the unit of the format.
    """
    header = F.concat(F.lit(BEGIN), escape(F.col("role"), role=True), F.lit(": "))
    turn = F.array(
        F.struct(header.alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), (F.col("role") == LOSS_ROLE).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )
    turns = F.sort_array(F.collect_list(F.struct("message", turn.alias("turn"))))
    return messages.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.flatten(F.transform("turns", lambda t: t.turn)).alias("segments")
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")


def parsed(text: Column) -> Column:
    """``array<struct<role, text>>`` read from a formatted conversation."""
    turns = F.filter(F.split(text, END), lambda t: t != "")
    start = len(BEGIN) + 1

    def turn(t: Column) -> Column:
        colon = F.instr(t, ": ")
        return F.struct(
            unescape(F.substring(t, F.lit(start), colon - start)).alias("role"),
            unescape(F.substring(t, colon + 2, F.length(t))).alias("text"),
        )

    return F.transform(turns, turn)


def rows_as_log(rows: DataFrame) -> DataFrame:
    """The event log of finished ``rows(conv_id, turn, role, text)``: each is opened and streamed in two deltas.

    Rows of one turn follow by role and text; rows without a turn come first.
    """
    inside = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    events = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("open").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.substring(text, F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), F.substring(text, half + 1, F.length(text)).alias("text")),
    )
    spread = rows.withColumn("copy", F.row_number().over(inside)).select("conv_id", "turn", "copy", "role", F.explode(events).alias("e"))
    return spread.select(
        "conv_id", F.struct("turn", "copy", "e.step").alias("seq"), F.struct("turn", "copy").alias("message"), "e.kind", "role", "e.text"
    )
