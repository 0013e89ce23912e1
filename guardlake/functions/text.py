"""Text rules as native column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from guardlake.functions import fixed_values as fv

_LOCAL = "A-Za-z0-9._%+-"

# A match may start only at the head of a run of address characters or where
# the last match ended. That is where a plain leftmost search starts anyway, but
# it keeps long unbroken runs linear in a backtracking engine.
_RUN_HEAD = rf"(?:(?<![{_LOCAL}])|\G)"


@dataclass(frozen=True)
class Entity:
    """A named pattern; ``needs`` is a literal every match contains (a cheap pre-test)."""

    name: str
    pattern: str
    needs: str | None = None

    @property
    def marker(self) -> str:
        return f"<{self.name}>"


EMAIL_ADDRESS = Entity("EMAIL_ADDRESS", rf"{_RUN_HEAD}[{_LOCAL}]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}", "@")
PHONE_NUMBER = Entity("PHONE_NUMBER", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "(")
IP_ADDRESS = Entity("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", ".")
PASSPORT = Entity("PASSPORT", r"(?<![0-9A-Za-z])[0-9]{9}(?![0-9A-Za-z])")
DEFAULT_ENTITIES = (EMAIL_ADDRESS, PHONE_NUMBER, IP_ADDRESS, PASSPORT)


def entities_from_json(text: str) -> tuple[Entity, ...]:
    """Custom entities from a JSON list of ``{"name", "patterns"}`` objects."""
    return tuple(
        Entity(item["name"], "|".join(f"(?:{pattern})" for pattern in item["patterns"]))
        for item in json.loads(text)
    )


def differs(col: Column, value: str) -> Column:
    """Inequality that keeps nulls."""
    return ~col.eqNullSafe(F.lit(value))


def longer_than(col: Column, n: int = fv.MIN_TEXT_LENGTH) -> Column:
    """Strictly more than ``n`` code points; null is not longer."""
    return F.coalesce(F.length(col) > n, F.lit(False))


def truncated(col: Column, n: int = fv.MAX_INPUT_CHARS) -> Column:
    return F.substring(col, 1, n)


def redact(col: Column, entities: tuple[Entity, ...] = (EMAIL_ADDRESS,)) -> Column:
    """Replace every entity by its marker. Texts without the entity's literal skip the regex."""
    for entity in entities:
        replaced = F.regexp_replace(col, entity.pattern, entity.marker)
        col = F.when(F.contains(col, F.lit(entity.needs)), replaced).otherwise(col) if entity.needs else replaced
    return col


def entity_values(col: Column, entity: Entity) -> Column:
    """All matches of one entity, in text order."""
    found = F.regexp_extract_all(col, F.lit(entity.pattern), F.lit(0))
    if entity.needs:
        empty = F.array().cast("array<string>")
        return F.when(F.contains(col, F.lit(entity.needs)), found).otherwise(empty)
    return found


def has_entity(col: Column, entity: Entity) -> Column:
    test = col.rlike(entity.pattern)
    if entity.needs:
        test = F.contains(col, F.lit(entity.needs)) & test
    return F.coalesce(test, F.lit(False))


def has_marker(col: Column, marker: str = fv.ENTITY_MARKER) -> Column:
    return F.coalesce(F.contains(col, F.lit(marker)), F.lit(False))


def tokens(col: Column) -> Column:
    """Whitespace tokens without empties."""
    return F.array_remove(F.split(col, r"[ \t\n\r\f]"), "")


def never_null(array: Column) -> Column:
    """An array of strings that is empty instead of null.

    With ``explode_outer`` this keeps a costly array to one evaluation: the
    planner has no null or size test to infer, which it would run on the array's
    own expression before exploding it. Joins drop the null row of an empty array.
    """
    return F.coalesce(array, F.array().cast("array<string>"))


def token_cap(col: Column, n: int = fv.MAX_TOKENS) -> Column:
    """The first ``n`` whitespace tokens, joined by one space."""
    return F.array_join(F.slice(tokens(col), 1, n), " ")


def reversed_text(col: Column) -> Column:
    return F.reverse(col)


def redact_strings(df: DataFrame, entities: tuple[Entity, ...] = (EMAIL_ADDRESS,)) -> DataFrame:
    """Redact every string of a result, however deep in arrays, structs and maps; the table keeps its types."""
    return df.select(
        *[_redact_within(F.col(f"`{f.name}`"), f.dataType, entities).alias(f.name) for f in df.schema.fields]
    )


def _redact_within(col: Column, kind: T.DataType, entities: tuple[Entity, ...]) -> Column:
    if isinstance(kind, T.StringType):
        return redact(col, entities)
    if not _holds_string(kind):
        return col
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _redact_within(x, kind.elementType, entities))
    if isinstance(kind, T.StructType):
        fields = [_redact_within(col[f.name], f.dataType, entities).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    entries = F.transform(
        F.map_entries(col),
        lambda e: F.struct(
            _redact_within(e["key"], kind.keyType, entities).alias("key"),
            _redact_within(e["value"], kind.valueType, entities).alias("value"),
        ),
    )
    if isinstance(kind.keyType, T.StringType):
        # Keys that redaction makes equal are numbered, so no entry is lost.
        entries = F.transform(
            entries,
            lambda e, i: F.struct(_numbered(e["key"], F.filter(F.slice(entries, F.lit(1), i), lambda o: o["key"] == e["key"])).alias("key"),
                                  e["value"].alias("value")),
        )
    return F.map_from_entries(entries)


def _numbered(key: Column, before: Column) -> Column:
    return F.when(F.size(before) == 0, key).otherwise(F.concat(key, F.lit(" #"), F.size(before) + 1))


def _holds_string(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_string(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_string(kind.keyType) or _holds_string(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_string(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType)


def any_string(col: Column, kind: T.DataType, test: Callable[[Column], Column]) -> Column:
    """Whether some string inside a value passes ``test``; false where there is none."""
    if isinstance(kind, T.StringType):
        return F.coalesce(test(col), F.lit(False))
    if not _holds_string(kind):
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(col, lambda x: any_string(x, kind.elementType, test)), F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [any_string(col[f.name], f.dataType, test) for f in kind.fields if _holds_string(f.dataType)]
        return reduce(or_, parts)
    keys = any_string(F.map_keys(col), T.ArrayType(kind.keyType), test)
    return keys | any_string(F.map_values(col), T.ArrayType(kind.valueType), test)


def text_metrics(col: Column, prefix: str) -> dict[str, Column]:
    """Per-text counts: characters, words, sentences, mean word length, non-alphabetic share."""
    words = F.size(tokens(col))
    letters = F.length(F.regexp_replace(col, r"[ \t\n\r\f]+", ""))
    chars = F.length(col)
    alphabetic = F.length(F.regexp_replace(col, r"[^A-Za-z]", ""))
    return {
        f"{prefix}_chars": chars.cast("bigint"),
        f"{prefix}_words": words.cast("bigint"),
        f"{prefix}_sentences": F.size(
            F.filter(F.split(col, r"[.!?]+"), lambda s: F.regexp_replace(s, r"[ \t\n\r\f]+", "") != "")
        ).cast("bigint"),
        f"{prefix}_mean_word": F.when(words > 0, letters / words).otherwise(F.lit(0.0)),
        f"{prefix}_non_alpha": F.when(chars > 0, 1 - alphabetic / chars).otherwise(F.lit(0.0)),
    }


def word_overlap(left: Column, right: Column) -> Column:
    """Share of the left text's distinct words that also occur in the right text."""
    distinct = F.array_distinct(tokens(left))
    shared = F.size(F.array_intersect(distinct, tokens(right)))
    return F.when(F.size(distinct) > 0, shared / F.size(distinct)).otherwise(F.lit(0.0))
