"""Entities with their places in the text: spans of patterns and of names, overlaps settled, one redaction from spans.

Spans are rows ``(id, start, end, entity, priority)``: ``start`` counts characters from 0, ``end`` is behind the last one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from guardlake.functions.text import Entity
from guardlake.session import settled

# Slots of the table that tells a task which tokens may begin a name; a fixed size for any number of names.
SLOTS = 1 << 20
# Tokens of a name at most: what is spelled at a possible first token.
MAX_WORDS = 8
# Different tokens a task remembers at a time.
SEEN_TOKENS = 1 << 16
# Marks that do not belong to a name's word when they stand at either end of it.
EDGES = ".,;:!?()"


def entity_spans(df: DataFrame, id_col: str, text: str, entities: Sequence[Entity]) -> DataFrame:
    """Spans of all matches, with their ``value``; the first entity has priority 0, the strongest.

    Texts do not travel: only matches and the lengths of the stretches between them leave their row.
    """
    found = []
    for place, entity in enumerate(entities):
        matches = F.regexp_extract_all(text, F.lit(entity.pattern), F.lit(0))
        gaps = F.transform(F.split(F.col(text), entity.pattern, -1), lambda part: F.length(part))
        rows = F.arrays_zip(matches.alias("value"), F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"))
        if entity.needs:
            rows = F.when(F.contains(F.col(text), F.lit(entity.needs)), rows)
        found.append(F.struct(F.lit(entity.name).alias("entity"), F.lit(place).alias("priority"), rows.alias("rows")))
    flat = df.where(F.col(text).isNotNull()).select(id_col, F.explode(F.array(*found)).alias("e")).where(F.size("e.rows") > 0)
    flat = flat.select(id_col, "e.entity", "e.priority", F.posexplode("e.rows").alias("nth", "m"))
    upto = Window.partitionBy(id_col, "entity").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.value")).over(upto).cast("int")
    placed = flat.withColumn("end", end)
    return placed.select(
        id_col, (F.col("end") - F.length("m.value")).alias("start"), "end", "entity", "priority", F.col("m.value").alias("value")
    )


def name_spans(
    df: DataFrame, id_col: str, text: str, names: DataFrame, name: str, entity: str = "PERSON", priority: int = 0,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Spans of dictionary names of up to ``max_words`` words, with their ``value``; at one place the longest name wins.

    Words are what stands between white space, without marks at their ends; marks inside a name's span count as between
    words. Names are a table of any size, keyed by their words. One pass over the texts spells the sequences
    that begin with a word which may begin a name and are as long as such names may be, by a table of ``SLOTS``
    lengths; a second one of as many marks, by the whole sequence, leaves out most that are no names. The equi-join with
    the names decides. A longer name raises an error.
    """
    bare = F.transform(F.split(F.col(name), r"[ \t\n\r\f]"), lambda w: F.trim(w, F.lit(EDGES)))
    words = F.filter(bare, lambda w: w != "")
    known = names.select(words.alias("words")).where(F.size("words") > 0)
    known = settled(known.select(F.array_join("words", " ").alias("key"), F.size("words").alias("n")).distinct(), "names")
    slot = F.crc32(F.substring_index("key", " ", 1).cast("binary")) % SLOTS
    longest = np.zeros(SLOTS, np.uint8)
    for r in known.groupBy(slot.cast("int").alias("slot")).agg(F.max("n").alias("n")).collect():  # at most SLOTS rows
        if r.n > max_words:
            raise ValueError(f"names have at most {max_words} words")
        longest[r.slot] = r.n
    marks = np.zeros(SLOTS, np.bool_)
    for r in known.select((F.crc32(F.col("key").cast("binary")) % SLOTS).cast("int").alias("slot")).distinct().collect():  # at most SLOTS rows
        marks[r.slot] = True
    shared, slots, edges = df.sparkSession.sparkContext.broadcast((longest.tobytes(), marks.tobytes())), SLOTS, EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, (table, whole) = re.compile("[^ \t\n\r\f]+"), shared.value
        seen = {}  # a token's word, where it begins, and how long names that it begins may be
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows, keys, starts, ends = [], [], [], []
                for row, value in enumerate(part.column(1).to_pylist()):
                    words, places, firsts = [], [], []
                    for m in token.finditer(value or ""):
                        raw = m[0]
                        known_token = seen.get(raw)
                        if known_token is None:
                            word = raw.strip(edges)
                            if len(seen) >= SEEN_TOKENS:
                                seen.clear()
                            n = table[zlib.crc32(word.encode()) % slots] if word else 0
                            known_token = seen[raw] = (word, raw.index(word), n)
                        word, skipped, n = known_token
                        if word:
                            if n:
                                firsts.append((len(words), n))
                            words.append(word)
                            places.append(m.start() + skipped)
                    for i, n in firsts:
                        key = ""
                        for j in range(i, min(i + n, len(words))):
                            key = f"{key} {words[j]}" if key else words[j]
                            if whole[zlib.crc32(key.encode()) % slots]:
                                rows.append(row), keys.append(key), starts.append(places[i]), ends.append(places[j] + len(words[j]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(rows)), pa.array(keys), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                        ],
                        names=["id", "key", "start", "end"],
                    )

    kind = df.schema[id_col].dataType.simpleString()
    spelled = df.select(F.col(id_col).alias("id"), text).mapInArrow(run, f"id {kind}, key string, start int, end int")
    met = spelled.join(known.select("key"), "key")
    longest_here = met.groupBy("id", "start").agg(F.max(F.struct("end", "key")).alias("m"))
    return longest_here.select(
        F.col("id").alias(id_col), "start", "m.end", F.lit(entity).alias("entity"), F.lit(priority).alias("priority"), F.col("m.key").alias("value")
    )


def resolve(spans: DataFrame, id_col: str) -> DataFrame:
    """The spans that stay where spans overlap: by priority (0 first), then length, then place, then entity.

    Taken in that order, a span stays if it meets none that stayed; the order of the rows or of the patterns does not
    matter, and equal spans of one entity are one. Only spans that hang together by overlaps are compared, so a
    text with very many of them is no heavier than its longest chain; a span that meets no other stays as it is.
    """
    spans = spans.repartition(id_col)  # the one shuffle: what follows is within a text
    by_place = Window.partitionBy(id_col).orderBy("start", "end", "entity", "priority")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    distinct = spans.where(F.col("end") > F.col("start")).groupBy(id_col, "start", "end", "entity").agg(
        F.min("priority").alias("priority"), F.min("value").alias("value")
    )
    new = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    chained = distinct.withColumn("_new", new)
    chained = chained.withColumn("_chain", F.sum("_new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("priority", (F.col("start") - F.col("end")).alias("short"), "start", "entity", "end", "value")
    chained = chained.withColumn("_alone", (F.col("_new") == 1) & (F.lead("_new", 1, 1).over(by_place) == 1))
    chains = chained.where("NOT _alone").groupBy(id_col, "_chain").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    kept = F.aggregate(
        "_spans", F.slice("_spans", 1, 0),
        lambda stay, s: F.when(
            F.exists(stay, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), stay
        ).otherwise(F.concat(stay, F.array(s))),
    )
    columns = [id_col, "start", "end", "entity", "priority", "value"]
    settled_chains = chains.select(id_col, F.explode(kept).alias("s")).select(id_col, *[f"s.{c}" for c in columns[1:]])
    return chained.where("_alone").select(*columns).unionByName(settled_chains)


def redact_spans(df: DataFrame, id_col: str, text: str, spans: DataFrame) -> DataFrame:
    """``df`` with every span of its text replaced by the marker of its entity, in one pass; spans must not overlap."""
    listed = spans.groupBy(F.col(id_col).alias("_own")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "entity"))).alias("_spans")
    )
    joined = df.join(settled(listed, "spans"), F.col(id_col) == F.col("_own"), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["end"]))
    ends = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length(text)))
    markers = F.concat(F.transform("_spans", lambda s: F.concat(F.lit("<"), s["entity"], F.lit(">"))), F.array(F.lit("")))
    pieces = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b"), markers.alias("m")),
        lambda p: F.concat(F.substring(F.col(text), p["a"] + 1, p["b"] - p["a"]), p["m"]),
    )
    redacted = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    return joined.withColumn(text, redacted).drop("_own", "_spans")
