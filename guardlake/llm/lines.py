"""Line dedup over windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from guardlake.llm.common import unused
from guardlake.session import settled

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _filled(lines: Column) -> Column:
    """Places of the lines that hold more than ASCII white space."""
    places = F.transform(lines, lambda line, i: F.when(line.rlike("[^\\x20\\x09-\\x0D]"), i))
    return F.filter(places, lambda i: i.isNotNull())


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, place, h1, h2)``: a hash of 128 bits for every three consecutive lines of every text.

    Blank lines are passed over: ``place`` counts the others. ``row`` is a hash of the text, so that rows of one id
    with different texts are kept apart.
    """
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), _lines(F.col(text_col)).alias("every"))
    base = base.where(F.size("every") >= WINDOW).select(
        "id", "row", F.filter("every", lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("l")
    )

    def window(p: Column) -> Column:
        a, b, c = (F.get("l", p + i) for i in range(WINDOW))
        return F.struct(
            p.alias("place"), F.xxhash64(a, b, c).alias("h1"), F.xxhash64(c, F.lit(7), a, F.lit(11), b).alias("h2")
        )

    made = F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), window))
    return base.where(F.size("l") >= WINDOW).select("id", "row", made.alias("w")).select("id", "row", "w.*")


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, places)``: where later occurrences of repeated windows begin, per text that has any.

    The first occurrence is that of the least (id, text hash, place), null ids first. Windows are counted before the shuffle. A
    common window makes a skewed join key; both sides of the join are exchanged files, so AQE splits it.
    """
    found = windows(docs, id_col, text_col)
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "place")).alias("first"), F.count("*").alias("n"))
    firsts = settled(firsts.where("n > 1").select("h1", "h2", "first"), "repeated_windows")
    later = found.join(firsts, ["h1", "h2"]).where(~F.struct("id", "row", "place").eqNullSafe(F.col("first")))
    return later.groupBy("id", "row").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated three-line windows taken out, and ``n_lines``, ``n_removed`` (suffixed
    with ``_`` where the names are taken).

    Every line that a later occurrence covers goes, overlapping and touching occurrences merged; blank lines stay. A
    text of fewer than three filled lines has no window and stays as it is, null stays null. Rows that repeat both id
    and text are one occurrence: what goes from one goes from all of them. An empty table gives no rows.
    """
    own, row, gone = (unused(docs, c) for c in ("own_id", "own_row", "gone"))
    places = repeated_places(docs, id_col, text_col).select(
        F.col("id").alias(own), F.col("row").alias(row), F.col("places").alias(gone)
    )
    places = settled(places, "repeated_places")
    # However few repeats there are here, their number follows the input: never a broadcast.
    joined = docs.join(places.hint("merge"), docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text_col]) == F.col(row)), "left")
    every, filled, cut = (unused(docs, c) for c in ("every", "filled", "cut"))
    split = joined.withColumn(every, _lines(F.col(text_col))).withColumn(
        filled, F.when(F.col(gone).isNotNull(), _filled(F.col(every)))
    )
    covered = F.flatten(F.transform(F.col(gone), lambda p: F.transform(
        F.sequence(p, p + (WINDOW - 1)), lambda j: F.get(F.col(filled), j))))
    split = split.withColumn(cut, F.when(F.col(gone).isNotNull(), F.array_distinct(covered)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(cut))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col(every), i)), "\n")
    lines, removed = unused(docs, "n_lines"), unused(docs, "n_removed")
    out = split.withColumn(lines, F.size(every)).withColumn(removed, F.coalesce(F.size(cut), F.lit(0)))
    out = out.withColumn(removed, F.when(F.col(gone).isNull(), 0).otherwise(F.col(removed)))
    out = out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(text))
    return out.select(*docs.columns, lines, removed)
