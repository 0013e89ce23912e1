"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window

from guardlake.llm.common import per_text, unused
from guardlake.session import settled

#: ``[\x20\x09-\x0D]``, the characters that equality ignores.
BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 16_384, 11


def chunk_bounds(parts: list[bytes]) -> list[list[int]]:
    """End offsets of the content-defined chunks of each text.

    A gear hash of the last 32 bytes (each byte's table value, doubled per step of age) marks a cut where its top
    ``CUT_BITS`` bits are zero; chunks hold at least ``MIN_CHUNK`` and at most ``MAX_CHUNK`` bytes. All texts
    are hashed in one sweep: no cut is looked for in a text's first ``MIN_CHUNK`` bytes, so none depends on what
    lies before it.
    """
    gear = np.random.default_rng(20_240_229).integers(0, 2**32, 256, dtype=np.uint32)
    h = gear[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    for age in (1, 2, 4, 8, 16):
        older = h[:-age] << np.uint32(age)
        h[age:] += older
    marks = np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1
    bounds, start = [], 0
    firsts = np.searchsorted(marks, np.cumsum([0] + [len(p) for p in parts]))
    for k, part in enumerate(parts):
        ends, last = [], 0
        for m in (marks[firsts[k] : firsts[k + 1]] - start).tolist():
            while m - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if m - last >= MIN_CHUNK:
                ends.append(m)
                last = m
        while len(part) - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if len(part) > last:
            ends.append(len(part))
        bounds.append(ends)
        start += len(part)
    return bounds


def _stripped(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").translate(None, BLANKS) for t in texts]


def _chunks(parts: list[bytes], hash_bytes: int):
    for part, ends in zip(parts, chunk_bounds(parts)):
        yield part, [
            (xxhash.xxh3_128_digest(part[a:b])[:hash_bytes], part[a:b]) for a, b in zip([0, *ends[:-1]], ends)
        ]


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """``(id, n_points, sha256, recipe)`` per row: code points of the text, digest of its normal form, chunk hashes."""

    def make():
        def work(ids, texts):
            parts = _stripped(texts)
            return {
                "id": ids, "n_points": pa.array([len(t) for t in texts], pa.int64()),
                "sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
                "recipe": pa.array([b"".join(h for h, _ in c) for _, c in _chunks(parts, hash_bytes)], pa.binary()),
            }

        return work

    return per_text(docs, id_col, text_col, "id ID_TYPE, n_points long, sha256 string, recipe binary", make)


def chunk_contents(docs: DataFrame, text_col: str = "text", hash_bytes: int = 16, placed: bool = False) -> DataFrame:
    """Chunks with their bytes: once per text slice, or with ``placed`` every one with its text's digest and place."""

    def make():
        def work(_, texts):
            parts = list(dict.fromkeys(_stripped(texts)))
            rows = [
                (hashlib.sha256(part).hexdigest() if placed else "", i if placed else 0, h, c)
                for part, chunks in _chunks(parts, hash_bytes) for i, (h, c) in enumerate(chunks)
            ]
            rows = list(dict.fromkeys(rows))
            sha, place, chunk, content = zip(*rows) if rows else ((), (), (), ())
            return {
                "sha256": pa.array(sha, pa.string()), "place": pa.array(place, pa.int32()),
                "chunk": pa.array(chunk, pa.binary()), "content": pa.array(content, pa.binary()),
            }

        return work

    source = docs.select(F.lit(0).alias("id"), text_col)
    made = per_text(source, "id", text_col, "sha256 string, place int, chunk binary, content binary", make)
    return made if placed else made.select("chunk", "content")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """``recipes`` with the column ``variants``, so that equal (recipe, variants) means equal normal forms for certain.

    Each distinct chunk moves once, to be compared byte by byte with the others of its hash; copies fold before the
    shuffle. A hash that stands for one content is that content's identifier. Where a hash stands for several, the
    contents are numbered, and ``variants`` names the places of a text that hold any but the first.
    """
    base = settled(recipes(docs, id_col, text_col, hash_bytes), "recipes")
    contents = chunk_contents(docs, text_col, hash_bytes).distinct()
    clashing = settled(contents.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk"), "clashes")
    if clashing.isEmpty():
        return base.withColumn("variants", F.lit(""))
    by_hash = Window.partitionBy("chunk").orderBy("content")
    numbered = contents.join(clashing, "chunk", "left_semi").withColumn("variant", F.row_number().over(by_hash) - 1)
    placed = chunk_contents(docs, text_col, hash_bytes, placed=True).join(clashing, "chunk", "left_semi").distinct()
    named = placed.join(settled(numbered.where("variant > 0"), "variants"), ["chunk", "content"])
    spelled = named.select("sha256", F.struct("place", "variant").alias("p")).groupBy("sha256").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("p")), lambda p: F.concat_ws(":", p.place, p.variant)), " ")
        .alias("variants")
    )
    joined = base.join(settled(spelled, "spelled"), "sha256", "left")
    named = joined.select("id", "n_points", "sha256", "recipe", F.coalesce("variants", F.lit("")).alias("variants"))
    return settled(named, "identified")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """Every row with the row that stays of its group: ``(id, keep_id, group_size, kept, sha256, n_points)``.

    Texts are equal when they agree after deleting spaces, tabs and line breaks; null counts as empty, and all empty
    texts are one group. The most code points stay, then the smallest id, null ids last. Rows that repeat both id
    and text count one by one in ``group_size`` and are all marked ``kept`` if their id stays; ``keep_one`` returns
    one of them. Groups are counted before the shuffle; joining them back, a large group is split by AQE, as
    both sides are files. Extra columns are not touched; an empty table gives no rows.
    """
    rows = identified(docs, id_col, text_col, hash_bytes)
    best = F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    groups = rows.groupBy("recipe", "variants").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    groups = settled(
        groups.select("recipe", "variants", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("most")),
        "groups",
    )
    joined = rows.join(groups, ["recipe", "variants"])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most"))
    return joined.select("id", "keep_id", "group_size", kept.alias("kept"), "sha256", "n_points")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns as they were; of rows that repeat id and text, one."""
    mark, points, rank = (unused(docs, s) for s in ("mark", "points", "rank"))
    stay = exact_groups(docs, id_col, text_col).where("kept").select(
        F.col("id").alias("_id"), F.col("sha256").alias("_sha"), F.col("n_points").alias("_n")
    ).distinct()
    stay = settled(stay, "stay")
    bare = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS.decode(), "")
    wide = docs.withColumn(mark, F.sha2(bare.cast("binary"), 256)).withColumn(
        points, F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    )
    match = (wide[mark] == stay["_sha"]) & wide[id_col].eqNullSafe(stay["_id"]) & (wide[points] == stay["_n"])
    one = Window.partitionBy(mark, id_col).orderBy(text_col)
    return (
        wide.join(stay.hint("merge"), match, "left_semi").withColumn(rank, F.row_number().over(one))
        .where(F.col(rank) == 1).select(*docs.columns)
    )
