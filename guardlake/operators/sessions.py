"""Operators along a conversation or a game session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from guardlake.functions import fixed_values as fv
from guardlake.operators.ordering import (
    HOT_ROWS, join_null_safe, running_totals, split_hot, with_position,
)

# Progression rows are narrow next to messages, so one task may order more of them.
HOT_TURNS = 10 * HOT_ROWS
# Turns one fold may hold at a time.
RUN_TURNS = 100_000


def last_messages(
    turns: DataFrame, conv: str, turn: str, role: str, text: str,
    n: int = fv.HISTORY_LENGTH, name: str = "history", hot_rows: int = HOT_ROWS, chunk: int = 4096,
) -> DataFrame:
    """Each turn with the last ``n`` messages up to and including itself.

    Ordinary conversations take one window. A hot one is cut into chunks of
    ``chunk`` turns, and the last ``n - 1`` turns of a chunk are copied into the
    next, so every window is complete and no task holds the conversation.
    """
    message = F.struct(F.col(role).alias("role"), F.col(text).alias("content"))
    cold, hot = split_hot(turns, [conv], hot_rows)
    recent = Window.partitionBy(conv).orderBy(turn).rowsBetween(-(n - 1), 0)
    done = cold.withColumn(name, F.collect_list(message).over(recent))
    if hot is None:
        return done
    placed = with_position(hot, [turn], group=[conv], name="_pos", hot_rows=hot_rows)
    own = F.floor(F.col("_pos") / chunk)
    also_next = (F.col("_pos") % chunk) >= (chunk - (n - 1))
    copies = F.when(also_next, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    recent = Window.partitionBy(conv, "_chunk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    return done.unionByName(
        spread.withColumn(name, F.collect_list(message).over(recent))
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_pos", "_own", "_chunk")
    )


def level_hits(text: Column, level_secrets: Sequence[Sequence[str]]) -> Column:
    """Per level whether the text is one of its secrets, as an array of booleans."""
    return F.array(*[F.coalesce(text.isin(*secrets), F.lit(False)) for secrets in level_secrets])


def progression(
    turns: DataFrame, session: str, order: str, hits: Column, levels: int, restart: Column | None = None,
    hot_rows: int = HOT_TURNS, run: int = RUN_TURNS,
) -> DataFrame:
    """The game state around every turn of a session.

    A turn that hits the secrets of the session's current level raises the level
    and clears the wrong counter; any other turn adds one to it. After the last
    level turns change nothing until a restart, which sets the level back to 0
    and leaves the wrong counter.

    The level depends on every earlier turn, yet no task folds a whole session:
    only turns that hit some level can move it, and those are folded per run of
    ``run`` turns for every possible starting level. The results of the
    runs are short and are chained per game. Adds ``level_before, correct, level_after, wrong_after, finished``.
    """
    is_restart = F.coalesce(restart, F.lit(False)) if restart is not None else F.lit(False)
    marked = turns.withColumns({"_hits": hits, "_restart": is_restart})
    placed = running_totals(
        marked,
        {"_pos": F.when(F.col("_restart"), 0).otherwise(1), "_game": F.col("_restart").cast("int")},
        [order], [session], hot_rows,
    )
    game = [session, "_game"]
    active = placed.where(~F.col("_restart"))

    hit = active.where(F.exists("_hits", lambda h: h))
    per_bucket = hit.groupBy(*game, F.floor(F.col("_pos") / run).alias("_bucket")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_hits"))).alias("_turns")
    )
    outcome = F.array(*[_fold_turns(start, levels) for start in range(levels)])
    outcomes = per_bucket.select(*game, F.struct("_bucket", outcome.alias("by_start")).alias("_o"))
    chained = F.aggregate(
        F.array_sort(F.collect_list("_o")),
        _state(F.lit(0)),
        lambda state, o: F.when(
            state["level"] < levels,
            F.struct(
                F.get(o["by_start"], state["level"])["level"].alias("level"),
                F.concat(state["at"], F.get(o["by_start"], state["level"])["at"]).alias("at"),
            ),
        ).otherwise(state),
    )
    raises = outcomes.groupBy(*game).agg(chained["at"].alias("_raises"))

    if restart is None:
        games = raises.withColumn("_base", F.lit(0))
    else:
        # The wrong counter runs on over a restart, so each game needs the position it counts from.
        games = join_null_safe(placed.groupBy(*game).agg(F.max("_pos").alias("_end")), raises, game, "left")
        complete = F.coalesce(F.size("_raises") == levels, F.lit(False))
        base = F.when(complete, F.col("_end")).otherwise(F.try_element_at("_raises", F.lit(-1)))
        earlier = Window.partitionBy(session).orderBy("_game").rowsBetween(Window.unboundedPreceding, -1)
        games = games.select(*game, "_raises", F.coalesce(F.max(base).over(earlier), F.lit(0)).alias("_base"))

    none = F.array().cast("array<bigint>")
    joined = join_null_safe(placed, games, game, "left").withColumns(
        {"_raises": F.coalesce("_raises", none), "_base": F.coalesce("_base", F.lit(0))}
    )
    pos = F.col("_pos")
    upto = F.filter("_raises", lambda p: p <= pos)
    before = F.filter("_raises", lambda p: p < pos)
    level_after = F.size(upto)
    return joined.withColumns(
        {
            "level_before": F.when(F.col("_restart"), 0).otherwise(F.size(before)).cast("bigint"),
            "correct": F.array_contains("_raises", pos) & ~F.col("_restart"),
            "level_after": F.when(F.col("_restart"), 0).otherwise(level_after).cast("bigint"),
            "wrong_after": F.when(level_after == levels, 0).otherwise(
                pos - F.greatest(F.col("_base"), F.coalesce(F.array_max(upto), F.lit(0)))
            ).cast("bigint"),
            "finished": (level_after == levels) & ~F.col("_restart"),
        }
    ).drop("_hits", "_restart", "_pos", "_game", "_raises", "_base")


def _state(level: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), F.array().cast("array<bigint>").alias("at"))


def _fold_turns(start: int, levels: int) -> Column:
    """Level reached, and the positions where it rose, from one starting level; at most ``levels`` rises."""
    return F.aggregate(
        F.col("_turns"),
        _state(F.lit(start)),
        lambda state, turn: F.when(
            (state["level"] < levels) & F.coalesce(F.get(turn["_hits"], state["level"]), F.lit(False)),
            F.struct(
                (state["level"] + 1).alias("level"), F.concat(state["at"], F.array(turn["_pos"])).alias("at")
            ),
        ).otherwise(state),
    )
