"""Turning model output into verdicts, names and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from guardlake.functions import fixed_values as fv

ROLE_ERROR = "a message needs one of the roles " + ", ".join(fv.ROLES)
VERDICT_SCHEMA = "answer string, credential boolean, reasoning string, _corrupt string"


def refused(response: Column, error: Column | None = None) -> Column:
    """A reply that carries the refusal marker, or an error body saying the check failed."""
    hit = F.coalesce(F.contains(response, F.lit(fv.REFUSAL_MARKER)), F.lit(False))
    if error is None:
        return hit
    return hit | F.coalesce(F.contains(error, F.lit(fv.REFUSAL_ERROR_MARKER)), F.lit(False))


def other_error(error: Column) -> Column:
    """Errors that are not verdicts; these must be surfaced, not counted as hits."""
    return F.when(error.isNotNull() & ~F.contains(error, F.lit(fv.REFUSAL_ERROR_MARKER)), error)


def unsafe_label(label: Column) -> Column:
    return label != fv.SAFE_LABEL


def argmax_label(scores: Column, labels: Sequence[str]) -> Column:
    """Label of the first largest score."""
    position = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(label) for label in labels]), position)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def top_class(scores: Column) -> Column:
    """Index of the first largest score, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


def class_verdict(scores: Column, mode: str = "compat", threshold: float = fv.CONFIDENCE_THRESHOLD) -> Column:
    """``compat`` compares the class index with the threshold; ``confidence`` compares class 1's probability."""
    if mode == "compat":
        return top_class(scores) > threshold
    if mode == "confidence":
        return (top_class(scores) == 1) & (F.array_max(softmax(scores)) >= threshold)
    raise ValueError(f"unknown mode {mode!r}")


def parse_verdict(raw: Column) -> Column:
    """Structured verdict; text that is not valid JSON is kept in ``_corrupt``."""
    return F.from_json(
        raw, VERDICT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )


def guard_status(used: Column, hit: Column) -> Column:
    return F.when(~used, "off").when(hit, "hit").otherwise("pass")


def with_fallback(response: Column, text: str = fv.FALLBACK_RESPONSE) -> Column:
    return F.coalesce(response, F.lit(text))


def message(role: str, content: Column) -> Column:
    if role not in fv.ROLES:
        raise ValueError(ROLE_ERROR)
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(user_text: Column, simple: str, structured: str, use_structured: Column) -> Column:
    """The system and user message of a turn."""
    system = F.when(use_structured, F.lit(structured)).otherwise(F.lit(simple))
    return F.array(message("system", system), message("user", user_text))


def config_name(model: Column, flags: Column) -> Column:
    """The model and its flags in name order, separated by a space; the bare model is the baseline."""
    return F.array_join(F.concat(F.array(model), F.array_sort(flags)), " ")


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)
