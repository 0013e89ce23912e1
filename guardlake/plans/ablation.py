"""Guard configurations compared on the same prompts: responses, leaks, leak rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from guardlake.functions import fixed_values as fv
from guardlake.functions import text as tx
from guardlake.functions.verdicts import with_fallback
from guardlake.operators.leak import leaked
from guardlake.session import settled

GATE = "use_pretrained_classifier"
OUTPUT_RAIL = "use_output_rail"
TOOL_RAIL = "use_tool_rail"
STRUCTURED = "use_structured_prompt"
FLAGS = (OUTPUT_RAIL, TOOL_RAIL, GATE, STRUCTURED)
MAX_CONFIGS = 256


@dataclass(frozen=True)
class GuardConfig:
    """The flags that are on; none is the baseline."""

    flags: tuple[str, ...] = ()

    def __post_init__(self):
        unknown = set(self.flags) - set(FLAGS)
        if unknown:
            raise ValueError(f"unknown flags {sorted(unknown)}")

    def name(self, model: str) -> str:
        return " ".join([model, *sorted(self.flags)])


def gated_response(response: Column, gate_hit: Column, config: GuardConfig) -> Column:
    """The gate replaces the response; rails redact only what the gate let through."""
    answer = with_fallback(response)
    if OUTPUT_RAIL in config.flags or TOOL_RAIL in config.flags:
        answer = tx.redact(answer)
    return F.when(gate_hit, F.lit(fv.GATE_RESPONSE)).otherwise(answer) if GATE in config.flags else answer


def _leak_columns(
    prompts: DataFrame, id_col: str, response: str, secrets: DataFrame, secret: str, gate: Column | None = None
) -> DataFrame:
    """Leaks of the two texts any configuration can answer with, as given and redacted; only rows that leak.

    The redacted text is looked through only where it differs.
    """
    raw = with_fallback(F.col(response))
    redacted = tx.redact(raw)
    same = F.coalesce(raw == redacted, F.lit(False))
    variants = prompts.select(
        id_col, *([] if gate is None else [gate.alias("_gate")]), same.alias("_same"), raw.alias("_raw"),
        F.when(~same, redacted).alias("_redacted"),
    )
    keys = [id_col] if gate is None else [id_col, "_gate"]
    found = leaked(variants, [*keys, "_same"], ["_raw", "_redacted"], secrets, secret)
    return found.select(*keys, "_raw", F.when(F.col("_same"), F.col("_raw")).otherwise(F.col("_redacted")).alias("_redacted"))


def _leak(config: GuardConfig, gate_hit: Column) -> Column:
    """The leak flag of a configuration, read off the two tested texts. The canned gate text holds no address."""
    redacts = OUTPUT_RAIL in config.flags or TOOL_RAIL in config.flags
    hit = F.coalesce(F.col("_redacted" if redacts else "_raw"), F.lit(False))
    return hit & ~gate_hit if GATE in config.flags else hit


def _checked(configs: Sequence[GuardConfig]) -> list[GuardConfig]:
    if len(configs) > MAX_CONFIGS:
        raise ValueError(f"at most {MAX_CONFIGS} configurations")
    return list(configs)


def ablation_long(
    prompts: DataFrame, id_col: str, response: str, gate_hit: Column, configs: Sequence[GuardConfig], model: str,
    secrets: DataFrame, secret: str,
) -> DataFrame:
    """``(id, config_name, leak)`` for every prompt and configuration.

    A configuration can only answer with one of three texts, so each prompt is
    leak-tested once and the expansion over configurations carries flags, not texts.
    """
    flagged = prompts.select(id_col, F.coalesce(gate_hit, F.lit(False)).alias("_gate")).join(
        _leak_columns(prompts, id_col, response, secrets, secret), id_col, "left"
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name(model)).alias("config_name"), _leak(c, F.col("_gate")).alias("leak")
            )
            for c in _checked(configs)
        ]
    )
    return flagged.select(id_col, F.explode(rows).alias("_r")).select(id_col, "_r.*")


def leak_rate(
    prompts: DataFrame, id_col: str, response: str, gate_hit: Column, configs: Sequence[GuardConfig], model: str,
    secrets: DataFrame, secret: str,
) -> DataFrame:
    """Prompts, leaks and leak rate per configuration.

    Prompts that do not leak only matter as a count, so they are counted without
    reading their text twice, and the rows that leak carry their gate flag along
    instead of being joined back.
    """
    gate = F.coalesce(gate_hit, F.lit(False))
    hits = _leak_columns(prompts, id_col, response, secrets, secret, gate)
    checked = _checked(configs)
    leaks = hits.agg(*[F.count_if(_leak(c, F.col("_gate"))).alias(str(i)) for i, c in enumerate(checked)])
    zero = F.lit(0).cast("bigint")

    def rows(counts: DataFrame, n_prompts: list[Column], n_leaks: list[Column]) -> DataFrame:
        per_config = F.array(
            *[
                F.struct(F.lit(c.name(model)).alias("config_name"), p.alias("n_prompts"), k.alias("n_leaks"))
                for c, p, k in zip(checked, n_prompts, n_leaks)
            ]
        )
        return counts.select(F.explode(per_config).alias("_r")).select("_r.*")

    n = len(checked)
    total = rows(prompts.agg(F.count(F.lit(1)).alias("_n")), [F.col("_n")] * n, [zero] * n)
    leaking = rows(leaks, [zero] * n, [F.col(str(i)) for i in range(n)])
    return rate(total.unionByName(leaking).groupBy("config_name").agg(
        F.sum("n_prompts").alias("n_prompts"), F.sum("n_leaks").alias("n_leaks")
    ))


def leak_rate_of(long: DataFrame) -> DataFrame:
    """The same summary from a stored long table."""
    return rate(long.groupBy("config_name").agg(
        F.count(F.lit(1)).alias("n_prompts"), F.count_if("leak").alias("n_leaks")
    ))


def rate(counts: DataFrame) -> DataFrame:
    share = F.col("n_leaks") / F.nullif(F.col("n_prompts"), F.lit(0))
    return counts.withColumn("leak_rate", F.coalesce(share, F.lit(0.0)))


def ablation_wide(
    prompts: DataFrame, id_col: str, response: str, gate_hit: Column, configs: Sequence[GuardConfig], model: str,
    secrets: DataFrame, secret: str,
) -> DataFrame:
    """One response and one leak column per configuration, written side by side without a pivot shuffle.

    The leaking ids are settled first: as long as they are few, the planner sees
    it from their files and the responses are joined where they lie.
    """
    gate = F.coalesce(gate_hit, F.lit(False))
    leaks = settled(_leak_columns(prompts, id_col, response, secrets, secret), "leaks")
    joined = prompts.withColumn("_gate", gate).join(leaks, id_col, "left")
    columns = []
    for c in _checked(configs):
        name = c.name(model)
        columns.append(gated_response(F.col(response), F.col("_gate"), c).alias(name))
        columns.append(_leak(c, F.col("_gate")).alias(f"leaks for config: {name}"))
    return joined.select(*prompts.columns, *columns)


def to_wide(long: DataFrame, id_col: str, values: Sequence[str], column: str) -> DataFrame:
    """Pivot a stored long table with known configuration names."""
    return long.groupBy(id_col).pivot("config_name", list(values)).agg(F.first(column))
