"""Readers. Every reader takes or carries an explicit schema, so no inference pass runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guardlake.functions import fixed_values as fv
from guardlake.operators.ordering import HOT_ROWS, running_totals
from guardlake.session import settled

ATTACK_SCHEMA = "user_input string, expected_completion string"
BENIGN_SCHEMA = "text string, lang string, role string"
PROMPT_SCHEMA = "id bigint, data string"
SQL_AUDIT_SCHEMA = "Query string, Label int"
LEVEL_SCHEMA = (
    "level int, use_mcp_server boolean, use_prompt_protection boolean, use_output_rail boolean, "
    "use_tool_rails boolean, model string, system_prompt string, emails array<string>"
)

# Level tables are configuration: a handful of rows. Anything larger is a mistake.
MAX_LEVELS = 1000

_LINE = r"^([0-9]{2}\.[0-9]{2}\.[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) ([A-Z]+) (.*)$"
_SPOKEN = r"^(User|Chatbot): '(.*)'$"


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached_corpus(spark: SparkSession, remote: str, local: str, schema: str) -> DataFrame:
    """Read the near copy; when it is absent, write it once from the remote corpus.

    A copy counts as present only once its success marker exists, so a copy cut
    short by a lost job is written again instead of being read half-done.
    """
    if not path_exists(spark, f"{local.rstrip('/')}/_SUCCESS"):
        spark.read.schema(schema).parquet(remote).write.mode("overwrite").parquet(local)
    return spark.read.schema(schema).parquet(local)


def read_labelled_csv(spark: SparkSession, path: str, schema: str = SQL_AUDIT_SCHEMA) -> DataFrame:
    """Quoted CSV with a header; texts may span lines."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompt table ``(id, data)``, from parquet or CSV."""
    if path.rstrip("/").endswith(".csv"):
        return read_labelled_csv(spark, path, PROMPT_SCHEMA)
    return spark.read.schema(PROMPT_SCHEMA).parquet(path)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """One row per level, from JSON lines."""
    return spark.read.schema(LEVEL_SCHEMA).json(path)


def level_rows(levels: DataFrame) -> list[dict]:
    """The level table as plain dicts, after checking that it is as small as configuration is."""
    rows = levels.orderBy("level").limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"a level table holds at most {MAX_LEVELS} rows")
    return [row.asDict() for row in rows]


def log_fields(line: Column, spans_lines: bool = False) -> dict[str, Column]:
    """Fields of one log line, or of a message that ``spans_lines``; ``parsed`` is false for continuation lines."""
    whole, spoken = [f"(?s){p[:-1]}\\z" if spans_lines else p for p in (_LINE, _SPOKEN)]
    stamp = F.regexp_extract(line, whole, 1)
    body = F.regexp_extract(line, whole, 3)
    speaker = F.regexp_extract(body, spoken, 1)
    is_spoken = speaker != ""
    return {
        "ts": F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(fv.LOG_TIMESTAMP_FORMAT)),
        "level": F.nullif(F.regexp_extract(line, whole, 2), F.lit("")),
        "message": F.when(stamp != "", body),
        "speaker": F.nullif(speaker, F.lit("")),
        "text": F.when(is_spoken, F.regexp_extract(body, spoken, 2)),
        "parsed": stamp != "",
    }


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines with their fields; works on a batch or a stream."""
    return lines.withColumns(log_fields(F.col(column)))


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed lines, and the lines that did not parse."""
    parsed = parse_log(spark.read.text(path))
    return parsed.where("parsed").drop("parsed"), parsed.where("NOT parsed").select("value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, part, line, value)``: the lines of text files in order; ``line`` orders a part, ``part`` a file.

    A part is what one task reads of a file, known by the byte it begins at. The order is written with the
    lines, so it holds however often they are read again.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    return settled(lines, "lines")


def join_messages(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(file, message_no, value)``: lines joined to messages, each from a line with a time stamp to the next such line.

    Lines before a file's first time stamp come as message 0 of their file. A message spans parts of a file as it
    spans lines; files of any size are numbered in ranges.
    """
    begins = F.col("value").rlike(_LINE)
    numbered = running_totals(lines, {"message_no": begins.cast("bigint")}, ["part", "line"], ["file"], hot_rows)
    ordered = F.array_sort(F.collect_list(F.struct("part", "line", "value")))
    whole = numbered.groupBy("file", "message_no").agg(ordered.alias("lines"))
    return whole.select("file", "message_no", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))


def read_messages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages of a log with their fields, whole where they span lines; and what stands before a file's first message."""
    joined = join_messages(numbered_lines(spark, path))
    parsed = joined.where("message_no > 0").withColumns(log_fields(F.col("value"), spans_lines=True)).drop("parsed")
    return parsed, joined.where("message_no = 0").select("file", "value")


def user_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines holding ``user`` or ``User``: two exact cases, wherever they stand in the line."""
    hit = F.lit(False)
    for marker in fv.USER_LINE_MARKERS:
        hit = hit | F.contains(F.col(column), F.lit(marker))
    return lines.where(hit)


def expose(df: DataFrame, name: str) -> DataFrame:
    """Make a table visible to guarded SQL."""
    df.createOrReplaceTempView(name)
    return df
