"""Policy rules, entity extraction and similarity to known attacks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from guardlake.functions import text as tx
from guardlake.session import settled

# Rules are configuration and sit in the plan.
MAX_RULES = 1000
# Rows or exemplar vectors of a ring that a task holds, and rows that one matrix product takes.
BLOCK_VECTORS, BLOCK_ROWS = 4_096, 1_024
# Pivots of the vector join, the exemplars they are picked from, and what rounding may add to an angle.
PIVOTS, PIVOT_SAMPLE, ANGLE_SLACK = 64, 1_024, 1e-6
# Similarities are compared after rounding, so equal vectors tie whatever block they came in.
DIGITS = 12


@dataclass(frozen=True)
class Rule:
    """``raise text if pattern in message``; ``regex`` makes the pattern a regular expression."""

    rule_id: str
    pattern: str
    text: str
    regex: bool = False

    def matches(self, col: Column) -> Column:
        return col.rlike(self.pattern) if self.regex else F.contains(col, F.lit(self.pattern))


def policy_hits(df: DataFrame, id_cols: Sequence[str], text: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per (message, rule) that matches. Rules are configuration and sit in the plan: no join."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    verdicts = F.array(
        *[
            F.when(
                rule.matches(F.col(text)),
                F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.text).alias("rule_text")),
            )
            for rule in rules
        ]
    )
    hits = df.select(*id_cols, F.explode(F.filter(verdicts, lambda v: v.isNotNull())).alias("_v"))
    return hits.select(*id_cols, "_v.*")


def extract_entities(
    df: DataFrame, id_col: str, text: str, entities: Sequence[tx.Entity] = tx.DEFAULT_ENTITIES
) -> DataFrame:
    """One row per entity found: ``(id, entity, ordinal, value)``. One pass, no shuffle."""
    per_entity = F.array(
        *[
            F.struct(F.lit(e.name).alias("entity"), tx.entity_values(F.col(text), e).alias("values"))
            for e in entities
        ]
    )
    return (
        df.select(id_col, F.explode(per_entity).alias("_e"))
        .select(id_col, F.col("_e.entity").alias("entity"), F.posexplode("_e.values").alias("ordinal", "value"))
    )


def extract_names(df: DataFrame, id_col: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Dictionary entities: a text's distinct tokens, stripped of punctuation, joined to a name table."""
    bare = F.transform(tx.tokens(F.col(text)), lambda t: F.trim(t, F.lit(".,;:!?()")))
    spoken = df.select(id_col, F.explode_outer(tx.never_null(F.array_distinct(bare))).alias("value"))
    known = names.select(F.col(name).alias("value")).distinct()
    return spoken.join(known, "value", "left_semi").select(id_col, F.lit("PERSON").alias("entity"), "value")


def nearest_exemplar(
    df: DataFrame, id_col: str, text: str, exemplars: DataFrame, ex_id: str, ex_text: str, threshold: float
) -> DataFrame:
    """Per text the exemplar whose distinct tokens it covers best, if at least ``threshold`` of them.

    Exact, without comparing every text with every exemplar. Texts keep only the tokens that exemplars have, as
    numbers, and all tokens are ordered by the number of texts that hold them. A text that covers ``need`` of an
    exemplar's ``n`` tokens holds at least one of its ``n - need + 1`` rarest, so only those are indexed, and it has at least
    ``need`` of the numbers. The pairs that meet are counted on the numbers, so texts are read and cut once. Exemplars may be of any number: what is joined is written before, and the planner picks
    the joins from the size of the files. Ties go to the smallest exemplar id; ids of texts are their keys.
    """
    words = exemplars.select(F.col(ex_id).alias("_ex"), F.array_distinct(tx.tokens(F.col(ex_text))).alias("_words"))
    words = words.where(F.size("_words") > 0)
    vocabulary = words.select(F.explode("_words").alias("_token")).distinct()
    vocabulary = settled(vocabulary.select("_token", F.monotonically_increasing_id().alias("_no")), "vocabulary")
    docs = df.select(id_col, tx.never_null(F.array_distinct(tx.tokens(F.col(text)))).alias("_tokens"))
    spoken = docs.select(id_col, F.explode_outer("_tokens").alias("_token")).join(vocabulary, "_token")
    held = settled(spoken.groupBy(id_col).agg(F.collect_set("_no").alias("_tokens")), "text-tokens")
    order = held.select(F.explode("_tokens").alias("_no")).groupBy("_no").agg(F.count(F.lit(1)).alias("_n"))
    rarest_first = F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_no").alias("no"))))
    sets = words.select("_ex", F.explode("_words").alias("_token")).join(vocabulary, "_token").join(order, "_no", "left")
    sets = sets.groupBy("_ex").agg(F.transform(rarest_first, lambda t: t["no"]).alias("_ex_tokens"))
    size = F.size("_ex_tokens")
    sets = settled(sets.withColumn("_need", F.greatest(F.ceil(size * threshold - 1e-9), F.lit(1)).cast("int")), "exemplar-tokens")

    prefix = F.slice("_ex_tokens", F.lit(1), size - F.col("_need") + 1)
    index = sets.select("_ex", "_need", F.explode(prefix).alias("_no"))
    places = held.select(id_col, F.size("_tokens").alias("_has"), F.explode("_tokens").alias("_no"))
    met = places.join(index, "_no").where(F.col("_has") >= F.col("_need")).select(id_col, "_ex").distinct()
    pairs = settled(met, "met").join(held, id_col).join(sets, "_ex")
    scored = (
        pairs.withColumn("_overlap", F.size(F.array_intersect("_ex_tokens", "_tokens")))
        .where(F.col("_overlap") >= F.col("_need"))
        .select(id_col, "_ex", (F.col("_overlap") / size).alias("score"))
    )
    best = scored.groupBy(id_col).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_ex"))).alias("_b"))
    return best.select(id_col, F.col("_b._ex").alias(ex_id), (-F.col("_b.s")).alias("score"))


def nearest_vector(
    df: DataFrame, id_col: str, vector: str, exemplars: DataFrame, ex_id: str, ex_vector: str, threshold: float,
    block: int = BLOCK_VECTORS, pivots: int = PIVOTS,
) -> DataFrame:
    """Cosine form of the same test, for exemplars of any number and id type: an exact join by angle.

    Rows and exemplars meet in rings around pivots (see ``in_rings``), so only those are compared that may be near
    enough; the rows and exemplars of a ring are dealt to tasks in blocks of a fixed size. Rows and exemplars without a vector, or
    with a null in it, match nothing; a vector of zeros has similarity 0 to all; ties go to the smallest exemplar id.
    """
    whole = lambda c: F.col(c).isNotNull() & F.forall(F.col(c), lambda x: x.isNotNull())
    known = exemplars.where(whole(ex_vector)).select(F.col(ex_id).alias("_ex"), F.col(ex_vector).cast("array<double>").alias("_v"))
    rows = df.where(whole(vector)).select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    ringed, spread = in_rings(rows, settled(known, "exemplar-vectors"), threshold, pivots)
    place = ["_cell", "_ring"]

    def parts(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    both = settled(parts(ringed, "_row_parts").join(parts(spread, "_ex_parts"), place), "rings")
    number = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = ringed.join(both, place).select("*", number("_id", "_row_parts").alias("_a"), every("_ex_parts").alias("_b"))
    right = spread.join(both, place).select("*", number("_ex", "_ex_parts").alias("_b"), every("_row_parts").alias("_a"))
    right = right.select(*[F.col(c).alias(f"{c}_") for c in (*place, "_a", "_b")], "_ex", "_v")
    kinds = df.schema[id_col].dataType.simpleString(), exemplars.schema[ex_id].dataType.simpleString()
    digits, step, units_of = DIGITS, BLOCK_ROWS, _unit_rows()

    def best(asked, shown):
        ids, names, scores = [], [], []
        if len(asked) and len(shown):
            shown = shown.sort_by("_ex")
            units = units_of(shown.column("_v"))
            for begin in range(0, len(asked), step):
                part = asked.slice(begin, step)
                similarity = np.round(units_of(part.column("_v")) @ units.T, digits)
                found = similarity.argmax(axis=1)
                score = similarity[np.arange(len(found)), found]
                near = np.flatnonzero(score >= threshold)
                ids.append(part.column("_id").take(pa.array(near)))
                names.append(shown.column("_ex").take(pa.array(found[near])))
                scores.append(score[near])
        one = lambda parts, kind: pa.chunked_array([c for p in parts for c in p.chunks], kind)
        return pa.table({
            "_id": one(ids, asked.schema.field("_id").type), "_ex": one(names, shown.schema.field("_ex").type),
            "_score": np.concatenate([np.zeros(0), *scores]),
        })

    near = left.select(*place, "_a", "_b", "_id", "_v").groupBy(*place, "_a", "_b").cogroup(
        right.groupBy("_cell_", "_ring_", "_a_", "_b_")
    ).applyInArrow(best, f"_id {kinds[0]}, _ex {kinds[1]}, _score double")
    one = near.groupBy("_id").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_ex").alias("e"))).alias("_b"))
    return one.select(F.col("_id").alias(id_col), F.col("_b.e").alias(ex_id), (-F.col("_b.s")).alias("score"))


def _angles():
    """A function for tasks: angles of unit vectors in the rows of one array to those of another."""
    return lambda x, y: np.arccos(np.clip(x @ y.T, -1, 1))


def in_rings(rows: DataFrame, exemplars: DataFrame, threshold: float, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Rows ``(_id, _v)`` and exemplars ``(_ex, _v)`` with ``_cell`` and ``_ring``: pairs at the threshold share both.

    A row lies in the cell of its nearest pivot, in a ring of its angle to it; it is listed once. An exemplar within an
    angle of ``reach`` of a row is, by the triangle inequality, at most twice ``reach`` farther from the row's pivot than
    from its own nearest, and its angle to that pivot differs from the row's by at most ``reach``: it is listed in those
    cells and rings. Pivots are exemplars that lie far apart, picked from at most ``PIVOT_SAMPLE`` of them. From a threshold of 0
    down every ring may hold a match, and all share one.
    """
    angles, units = _angles(), _unit_rows()
    far = threshold <= 0
    reach = np.pi if far else float(np.arccos(min(1.0, threshold))) + ANGLE_SLACK
    some = exemplars.orderBy(F.xxhash64("_ex"), "_ex").limit(PIVOT_SAMPLE).select("_v").toPandas()["_v"]
    sample = np.array([v for v in some if len(v) and any(v)], dtype=float)
    picked = []
    if len(sample) and not far:
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        away, at = np.full(len(sample), np.inf), 0
        while len(picked) < pivots and away[at] > reach / 2:
            picked.append(sample[at])
            away = np.minimum(away, angles(sample, sample[at : at + 1])[:, 0])
            at = int(away.argmax())
    centres = np.array(picked)

    def place(batches, every):
        for batch in batches:
            x = units(batch.column(1))
            if not len(centres):
                at, cell, ring = (np.arange(len(x)) if far else np.zeros(0, int)), np.zeros(len(x), int), np.zeros(len(x), int)
            else:
                angle = angles(x, centres)
                some = np.flatnonzero((x != 0).any(axis=1))  # of zeros nothing is as near as a positive threshold
                if every:
                    at, cell = np.nonzero(angle[some] <= angle[some].min(axis=1, keepdims=True) + 2 * reach)
                    at = some[at]
                    first = np.floor(np.maximum(angle[at, cell] - reach, 0) / reach).astype(int)
                    last = np.floor((angle[at, cell] + reach) / reach).astype(int)
                    number = last - first + 1
                    ring = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
                    at, cell = np.repeat(at, number), np.repeat(cell, number)
                else:
                    at, cell = some, angle[some].argmin(axis=1)
                    ring = np.floor(angle[at, cell] / reach).astype(int)
            number = len(at)
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(at)) for c in batch.columns], *[pa.array(v[:number], pa.int32()) for v in (cell, ring)]],
                names=[*batch.schema.names, "_cell", "_ring"],
            )

    def keyed(table: DataFrame, every: bool) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
        return settled(table.mapInArrow(lambda batches: place(batches, every), f"{fields}, _cell int, _ring int"), "in-rings")

    return keyed(rows, False), keyed(exemplars, True)


def _unit_rows():
    """A function for tasks: the unit vectors of a list column without nulls; zeros stay zeros."""

    def units(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm == 0, 1, norm)

    return units
