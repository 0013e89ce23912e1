"""Read-only SQL over allow-listed tables, and the audit of logged queries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from guardlake.functions import fixed_values as fv
from guardlake.functions import text as tx

# A quoted part ends at its quote or, when it is unbalanced, at the end of the text.
_QUOTED = r"""'[^']*('|\z)|"[^"]*("|\z)"""
# What a parsed query may be made of. Anything else (scripts, table functions, identifiers made of strings, writes) is refused.
PLAN_NODES = frozenset(
    "Aggregate Distinct Except Filter GlobalLimit Intersect Join LocalLimit Offset OneRowRelation Pivot Project Sort SubqueryAlias"
    " Union UnresolvedHaving UnresolvedHint UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith Window"
    " WithWindowDefinition".split()
)
UNRESOLVED = frozenset(
    "UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedNamedLambdaVariable UnresolvedStar"
    " UnresolvedStarExcept UnresolvedWindowExpression".split()
)
FUNCTIONS = frozenset(
    "abs acos add_months aggregate any any_value approx_count_distinct array array_agg array_contains array_distinct array_join"
    " array_max array_min array_position array_size array_sort ascii avg base64 between bigint bool_and bool_or bround"
    " cast cbrt ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains corr cos"
    " count count_if cume_dist current_date current_timestamp date date_add date_diff date_format date_sub date_trunc datediff"
    " day dayofmonth dayofweek dayofyear decimal dense_rank double element_at endswith even every exists exp extract filter"
    " first first_value flatten float floor format_number format_string from_json get get_json_object greatest hash hour if"
    " ifnull initcap instr int isnan isnotnull isnull json_tuple lag last last_day last_value lcase lead least left len length"
    " levenshtein like ln locate log log10 log2 lower lpad ltrim make_date map map_concat map_entries map_from_arrays map_keys"
    " map_values max max_by md5 mean median min min_by minute mod mode month months_between named_struct negative nth_value"
    " ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod position pow power quarter rank regexp_count"
    " regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse right rint rlike round row_number"
    " rpad rtrim second sequence sha2 sign signum sin size slice smallint some sort_array split split_part sqrt startswith"
    " std stddev stddev_pop stddev_samp string struct substr substring substring_index sum tan timestamp tinyint to_date"
    " to_json to_timestamp transform translate trim trunc try_add try_cast try_divide try_element_at try_to_timestamp typeof"
    " ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear when width_bucket year zip_with".split()
)


# Names that mean facts of the session where no table has such a column.
SESSION_FACTS = frozenset("current_user session_user user current_catalog current_database current_schema".split())


@dataclass(frozen=True)
class SqlAnswer:
    """Either rows or an error text, never both."""

    rows: DataFrame | None = None
    error: str | None = None

    @property
    def status(self) -> str:
        return "error" if self.rows is None else "ok"


def _cleaned(query: str) -> str:
    query = query.strip()
    return query[:-1].strip() if query.endswith(";") else query


def check_query(query: str) -> str | None:
    """The text checks on one query; ``None`` when it may run."""
    query = _cleaned(query)
    if ";" in re.sub(_QUOTED.replace(r"\z", r"\Z"), "", query):
        return fv.MULTI_STATEMENT_ERROR
    if not query.lower().startswith(("select", "with")):
        return fv.NOT_SELECT_ERROR
    return None


def _not_allowed(spark: SparkSession, query: str, allowed: Sequence[str], functions: Iterable[str]) -> str | None:
    """Walk the plan that Spark's own parser makes of the query: its tables, functions and node kinds against allow-lists."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    known, usable, named, tables = {n.lower() for n in allowed}, {f.lower() for f in functions}, set(), []
    todo = [(plan, True)]
    while todo:
        node, is_plan = todo.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if is_plan and kind not in PLAN_NODES:
            return f"The query uses a form that is not allowed: {kind}"
        if kind == "UnresolvedAttribute":
            name = ".".join(_elements(node.nameParts())).lower()
            if name in SESSION_FACTS and not any(name in map(str.lower, spark.table(t).columns) for t in allowed):
                return f"'{name}' is not allowed"
        if not is_plan and kind.startswith("Unresolved") and kind not in UNRESOLVED or "WithUnresolvedIdentifier" in kind:
            return f"The query uses a form that is not allowed: {kind}"
        if kind == "UnresolvedRelation":
            tables.append(".".join(_elements(node.multipartIdentifier())))
        elif kind == "UnresolvedFunction":
            name = ".".join(_elements(node.nameParts())).lower()
            if name not in usable:
                return f"Function '{name}' is not allowed"
        elif kind == "UnresolvedWith":
            named |= {relation._1().lower() for relation in _elements(node.cteRelations())}
        todo += [(child, is_plan) for child in _elements(node.children())]
        todo += [(inner, _is_plan(inner)) for inner in _elements(node.innerChildren())]
        if is_plan:
            todo += [(expression, False) for expression in _elements(node.expressions())]
    # A name given by WITH is no table, unless it hides a table that is not allowed.
    named = {name for name in named if name in known or not spark.catalog.tableExists(name)}
    for name in tables:
        if name.lower() not in known | named:
            return f"Table '{name}' is not allowed"
    return None


def _is_plan(node: Any) -> bool:
    return ".plans." in node.getClass().getName() or node.getClass().getSimpleName() in PLAN_NODES


def _elements(sequence: Any) -> list:
    """A Scala sequence as a list."""
    return [sequence.apply(i) for i in range(sequence.size())]


def guarded_select(
    spark: SparkSession, query: str, allowed: Sequence[str], params: Sequence[Any] | Mapping[str, Any] | None = None,
    fetch_all: bool = True, row_limit: int | None = fv.ROW_LIMIT, always_cap: bool = False,
    redact_with: Sequence[tx.Entity] = (), functions: Iterable[str] = FUNCTIONS,
) -> SqlAnswer:
    """Run one SELECT over allowed tables and functions; errors come back as text.

    The row cap is added unless the text holds the word ``limit``; with
    ``always_cap`` it is added in any case, and with ``row_limit=None`` never. The query runs as a subquery, so a
    write hidden behind WITH does not parse and a trailing comment cannot
    swallow the cap. The answer stays a distributed DataFrame.
    """
    problem = check_query(query)
    if problem:
        return SqlAnswer(error=problem)
    query = _cleaned(query)
    wrapped = f"SELECT * FROM (\n{query}\n)"
    if row_limit is not None and (always_cap or "limit" not in query.lower()):
        wrapped += f" LIMIT {int(row_limit)}"
    args = dict(params) if isinstance(params, Mapping) else list(params) if params else None
    try:
        problem = _not_allowed(spark, wrapped, allowed, functions)
        if problem:
            return SqlAnswer(error=problem)
        rows = spark.sql(wrapped, args=args)
    except PySparkException as error:
        return SqlAnswer(error=f"SQL error: {error}")
    if not fetch_all:
        rows = rows.limit(1)
    return SqlAnswer(rows=tx.redact_strings(rows, tuple(redact_with)) if redact_with else rows)


def audit_queries(queries: DataFrame, query: str) -> DataFrame:
    """The same text checks over a column of logged queries: ``verdict`` and ``has_limit``."""
    space = F.lit(" \t\n\r\f\v")
    stripped = F.trim(F.col(query), space)
    shorter = F.rtrim(F.left(stripped, F.length(stripped) - 1), space)
    body = F.when(stripped.endswith(";"), shorter).otherwise(stripped)
    unquoted = F.regexp_replace(F.col("_body"), _QUOTED, "")
    lowered = F.lower(F.col("_body"))
    verdict = (
        F.when(F.contains(unquoted, F.lit(";")), "multi")
        .when(~(lowered.startswith("select") | lowered.startswith("with")), "not_select")
        .otherwise("ok")
    )
    return (
        queries.withColumn("_body", body)
        .withColumns({"verdict": verdict, "has_limit": F.contains(lowered, F.lit("limit"))})
        .drop("_body")
    )


def _entity_test(field: T.StructField, entities: Sequence[tx.Entity]) -> Column:
    """Whether a column's value, or any string inside it, holds an entity."""
    tests = [tx.any_string(F.col(f"`{field.name}`"), field.dataType, lambda s, e=e: tx.has_entity(s, e)) for e in entities]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def table_inventory(
    tables: Mapping[str, DataFrame], entities: Sequence[tx.Entity] = tx.DEFAULT_ENTITIES
) -> DataFrame:
    """Per table its rows and the rows where some string, at any depth, holds an entity, sorted by name."""
    parts = []
    for name, df in tables.items():
        hit = reduce(lambda a, b: a | b, [_entity_test(f, entities) for f in df.schema.fields], F.lit(False))
        parts.append(
            df.agg(
                F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_entity_rows")
            )
        )
    return reduce(DataFrame.unionByName, parts).orderBy("name")


def column_inventory(
    df: DataFrame, entities: Sequence[tx.Entity] = tx.DEFAULT_ENTITIES, exact_distinct: bool = False
) -> DataFrame:
    """Per column its name, type, nullability, null count, entity hits and distinct count, from one scan.

    The distinct count is a sketch unless ``exact_distinct`` asks for a second,
    pre-aggregated pass over hashed values.
    """
    names = df.columns
    fields = []
    for i, field in enumerate(df.schema.fields):
        col = F.col(f"`{field.name}`")
        hit = _entity_test(field, entities)
        measures = [
            F.lit(i).cast("bigint").alias("cid"), F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("type"), F.lit(not field.nullable).alias("notnull"),
            F.lit(None).cast("string").alias("dflt_value"), F.lit(None).cast("string").alias("pk"),
            F.count_if(col.isNull()).alias("n_null"), F.count_if(hit).alias("n_entity"),
        ]
        if not exact_distinct:
            measures.append(F.approx_count_distinct(col).alias("n_distinct"))
        fields.append(F.struct(*measures))
    described = df.agg(F.array(*fields).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
    if not exact_distinct:
        return described
    hashed = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("name"), F.sha2(F.col(f"`{n}`").cast("string"), 256).alias("h"))
                for n in names
            ]
        )
    ).alias("_v")
    values = df.select(hashed).select("_v.*").groupBy("name", "h").agg(F.count(F.lit(1)).alias("_n"))
    counts = values.groupBy("name").agg(F.count("h").alias("n_distinct"))
    return described.join(counts, "name", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)).cast("bigint"))


def describe_table(tables: Mapping[str, DataFrame], name: str, **options: Any) -> SqlAnswer:
    """``column_inventory`` of an allowed table, or the message that there is no such table."""
    if name not in tables:
        return SqlAnswer(error=f"There is no table named '{name}'")
    return SqlAnswer(rows=column_inventory(tables[name], **options))


def first_rows(df: DataFrame, order: Sequence[Column | str], row_limit: int = fv.ROW_LIMIT) -> DataFrame:
    return df.orderBy(*order).limit(row_limit)
