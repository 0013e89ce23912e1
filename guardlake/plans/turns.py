"""The guarded turn: input cut, guess test, input check, rails, statuses. One projection, batch or stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guardlake.functions import fixed_values as fv
from guardlake.functions import text as tx
from guardlake.functions.verdicts import guard_status, with_fallback
from guardlake.sources.readers import MAX_LEVELS

GUARDS = ("prompt_protection", "output_rail", "tool_rail")


def _setting(level: Column, levels: Sequence[dict], name: str) -> Column:
    on = [row["level"] for row in levels if row[name]]
    return F.coalesce(level.isin(*on), F.lit(False)) if on else F.lit(False)


def _guess(level: Column, text: Column, levels: Sequence[dict]) -> Column:
    hit = F.lit(False)
    for row in levels:
        if row.get("emails"):
            hit = hit | ((level == row["level"]) & text.isin(*row["emails"]))
    return F.coalesce(hit, F.lit(False))


def guard_turns(
    turns: DataFrame, levels: Sequence[dict], gate: Column, keys: Sequence[str], level: str = "level",
    text: str = "text", response: str = "response", correct: str | None = None,
) -> DataFrame:
    """Guard every turn by its level's settings.

    Levels are configuration rows and become part of the expression. The input
    check only flags here. The tool rail redacts before its marker test, the
    output rail between the two tests, so a marker left by the tool rail also
    counts for the output rail. A correct guess is not guarded. ``correct``
    names a ready-made guess column; without it the level's own addresses decide.
    """
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"at most {MAX_LEVELS} levels")
    lv = F.col(level)
    cut = turns.withColumn(text, tx.truncated(F.col(text)))
    guess = F.col(correct) if correct else _guess(lv, F.col(text), levels)
    staged = cut.withColumns(
        {
            "correct": guess,
            "_use_prompt_protection": _setting(lv, levels, "use_prompt_protection"),
            "_use_output_rail": _setting(lv, levels, "use_output_rail"),
            "_use_tool_rail": _setting(lv, levels, "use_tool_rails"),
        }
    )
    answer = with_fallback(F.col(response))
    staged = staged.withColumn(
        "_tool", F.when(~F.col("correct"), F.when(F.col("_use_tool_rail"), tx.redact(answer)).otherwise(answer))
    ).withColumn("_out", F.when(F.col("_use_output_rail"), tx.redact(F.col("_tool"))).otherwise(F.col("_tool")))
    hits = {
        "prompt_protection_hit": ~F.col("correct") & F.col("_use_prompt_protection") & F.coalesce(gate, F.lit(False)),
        "tool_rail_hit": tx.has_marker(F.col("_tool")),
        "output_rail_hit": F.col("_use_output_rail") & tx.has_marker(F.col("_out")),
    }
    statuses = {
        f"{guard}_status": F.when(~F.col("correct"), guard_status(F.col(f"_use_{guard}"), F.col(f"{guard}_hit")))
        for guard in GUARDS
    }
    return staged.withColumns(hits).withColumns(statuses).select(
        *keys, level, text, "correct", F.col("_out").alias("response"), *hits, *statuses
    )


def guard_summary(guarded: DataFrame, level: str = "level") -> DataFrame:
    """Turns per level, guard and status, with totals per level and guard and overall (null = all)."""
    stacked = guarded.select(
        level,
        F.explode(
            F.array(
                *[F.struct(F.lit(g).alias("guard"), F.col(f"{g}_status").alias("status")) for g in GUARDS]
            )
        ).alias("_g"),
    ).select(level, "_g.*").where(F.col("status").isNotNull())
    return stacked.rollup("guard", level, "status").agg(F.count(F.lit(1)).alias("n_turns"))
