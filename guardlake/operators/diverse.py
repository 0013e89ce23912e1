"""Diverse subsets: farthest-point selection on cosine distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from guardlake.session import scratch_path, settled

# Farthest rows the driver holds of all clusters together, and of each at least; fixed numbers, whatever the table size.
POOL, POOL_OF_CLUSTER = 1024, 64
# Clusters at most, rows of one about, rows their centres are picked from, and what rounding may add to an angle.
CLUSTERS, CLUSTER_ROWS, CENTRE_SAMPLE, ANGLE_SLACK = 256, 20_000, 2_048, 1e-6
# Below every row: no distance, no id.
NOTHING = (-1.0, -np.inf)
# Rows of which a task picks local representatives at a time.
PART_ROWS = 100_000
# Distances are compared after rounding, so equal vectors tie whatever batch they came in.
DIGITS = 12


def cosine_distance(u: Column, v: Column) -> Column:
    """1 - cosine similarity of two arrays; a zero vector has distance 1 to everything."""
    dot = F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(_square_sum(u)) * F.sqrt(_square_sum(v))
    return F.when(norm > 0, 1 - dot / norm).otherwise(F.lit(1.0))


def _square_sum(u: Column) -> Column:
    return F.aggregate(u, F.lit(0.0), lambda acc, x: acc + x * x)


def _min_distance(chosen):
    """Per row the smallest distance to the chosen unit vectors: one matrix product per Arrow batch."""

    @F.pandas_udf("double")
    def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        picked = np.asarray(chosen)
        for vectors in batches:
            if len(vectors) == 0:
                yield pd.Series([], dtype=float)
                continue
            x = np.stack(vectors.to_numpy()).astype(float)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            similarity = (x / np.where(n == 0, 1, n)) @ picked.T
            yield pd.Series(np.round(np.clip(1 - similarity.max(axis=1), 0, 2), digits))

    digits = DIGITS
    return distance


def _whole(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows with an id and a vector without nulls; others cannot be compared and take no part."""
    whole = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull())
    return vectors.where(whole).select(id_col, vector)


def farthest_points(
    vectors: DataFrame, k: int, id_col: str, vector: str, start_id: int, pool: int = POOL, cluster_rows: int = CLUSTER_ROWS,
    read: Callable[[int], None] | None = None,
) -> DataFrame:
    """Greedy farthest-point selection: ``(pick_order, id, min_dist)`` in pick order, exact for any ``k``.

    Each pick is the row whose smallest distance to the picks so far is largest (ties: smallest id). Vectors are
    written once, in clusters of known centre and radius. Of every cluster the driver holds its farthest rows, and an upper
    bound for the rest: distances only shrink as picks are added, so while the best row held beats all bounds it is the
    global answer. Otherwise a pass reads the clusters whose bound it does not beat, and no others. Distances are never
    stored: a pass finds them from the picks that, by the triangle inequality of angles, may be nearest to some row of
    the cluster. What the driver holds is bounded by ``CLUSTERS``, ``pool`` and ``k``; ``read`` is told the rows of every pass.
    """
    spark = vectors.sparkSession
    rows = _whole(vectors, id_col, vector)
    first = rows.where(F.col(id_col) == start_id).select(vector).first()
    if first is None:
        raise ValueError(f"no row with {id_col} = {start_id}")
    stored, centres, radius, sizes = _clustered(rows, id_col, vector, cluster_rows)
    held = pool if len(sizes) == 2 else max(POOL_OF_CLUSTER, pool // len(sizes))
    picks, units, taken = [(0, start_id, None)], [_unit(first[0])], {start_id}
    bound = np.full(len(sizes), 2.0)
    limit: list[tuple] = [(2.0, np.inf) if n else NOTHING for n in sizes]
    heads = [Head([], np.zeros((0, 0)), np.zeros(0)) for _ in sizes]
    while len(picks) < k:
        best, cluster = max((heads[c].best(), c) for c in range(len(sizes)))
        stale = [c for c in range(len(sizes)) if limit[c] > best]
        if stale:
            if read:
                read(int(sum(sizes[c] for c in stale)))
            _refresh(spark, stored, id_col, vector, stale, units, taken, centres, radius, bound, held, heads, limit)
            continue
        if best == NOTHING:
            break
        unit = heads[cluster].take()
        picks.append((len(picks), -best[1], float(best[0])))
        units.append(unit)
        taken.add(-best[1])
        for head in heads:
            head.nearer(unit)
    return spark.createDataFrame(picks, f"pick_order bigint, {id_col} bigint, min_dist double")


class Head:
    """The farthest rows of a cluster by rising id, with their distances; a row taken has a negative one."""

    def __init__(self, ids: list[int], unit: np.ndarray, dist: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable") if len(ids) else []
        self.id, self.unit, self.dist = [ids[i] for i in order], unit[order] if len(ids) else unit, dist[order] if len(ids) else dist

    def best(self) -> tuple:
        """Greatest distance, and the negative id of the row; of equals that of the smallest id."""
        at = int(self.dist.argmax()) if len(self.dist) else -1
        return (float(self.dist[at]), -self.id[at]) if at >= 0 and self.dist[at] >= 0 else NOTHING

    def take(self) -> np.ndarray:
        at = int(self.dist.argmax())
        self.dist[at] = -2.0
        return self.unit[at]

    def nearer(self, unit: np.ndarray) -> None:
        if len(self.dist):
            self.dist = np.minimum(self.dist, np.round(np.clip(1 - self.unit @ unit, 0, 2), DIGITS))


def _clustered(rows: DataFrame, id_col: str, vector: str, cluster_rows: int) -> tuple[str, np.ndarray, np.ndarray, list[int]]:
    """Rows written once by cluster: their path, unit centres, greatest angles to the centre, and sizes.

    Centres lie far apart in a sample of about ``CENTRE_SAMPLE`` rows; there are at most ``CLUSTERS``. Vectors of zeros have
    no angle: they go to a last cluster of their own, which nothing is ruled out for.
    """
    spark = rows.sparkSession
    number = rows.count()
    wanted = max(1, min(CLUSTERS, number // cluster_rows))
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    sample = rows.where(draw < int((1 << 30) * min(1.0, CENTRE_SAMPLE / max(1, number)))).select(vector).toPandas()[vector] if wanted > 1 else []
    found = np.array([_unit(v) for v in sample if any(v)])
    centres = found[:1]
    if len(found):
        away = 1 - found @ centres[0]
        while len(centres) < wanted and away.max() > 1e-9:
            centres = np.concatenate([centres, found[away.argmax()][None]])
            away = np.minimum(away, 1 - found @ centres[-1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy()).astype(float)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                near = (x / np.where(n == 0, 1, n)) @ centres.T if len(centres) else np.ones((len(x), 1)) * -1
                at = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), at], -1, 1))
                yield batch.assign(_cluster=np.where(n[:, 0] == 0, max(1, len(centres)), at), _angle=angle)

    path = scratch_path(spark, "clusters")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows.mapInPandas(assign, f"{fields}, _cluster int, _angle double").write.partitionBy("_cluster").parquet(path)
    back = spark.read.schema(f"{fields}, _angle double, _cluster int").parquet(path)
    facts = {r["_cluster"]: r for r in back.groupBy("_cluster").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("angle")).collect()}
    several = len(centres) > 1
    radius = np.array([facts[c].angle + ANGLE_SLACK if several and c in facts else np.pi for c in range(len(centres))] or [np.pi])
    sizes = [facts[c].n if c in facts else 0 for c in range(len(radius) + 1)]
    return path, centres, radius, sizes


def _refresh(spark, path, id_col, vector, stale, units, taken, centres, radius, bound, held, heads, limit) -> None:
    """Reads the stale clusters: their farthest rows, the first one not held, and so their bounds."""
    picked = np.stack(units)
    relevant = {}
    for c in stale:
        nearest = np.zeros(len(picked))
        if c < len(centres):
            angle = np.arccos(np.clip(picked @ centres[c], -1, 1)) - radius[c] - ANGLE_SLACK
            nearest = 1 - np.cos(np.maximum(angle, 0))
        relevant[c] = nearest <= bound[c] + 1e-9
    digits, gone, rows_held = DIGITS, frozenset(taken), held + 1

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for c, part in batch[~batch[id_col].isin(gone)].groupby("_cluster"):
                x = np.stack(part[vector].to_numpy()).astype(float)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                similarity = ((x / np.where(n == 0, 1, n)) @ picked[relevant[c]].T).max(axis=1)
                part = part.assign(_dist=np.round(np.clip(1 - similarity, 0, 2), digits))
                part = pd.concat([best[c], part]) if c in best else part
                best[c] = part.sort_values(["_dist", id_col], ascending=[False, True]).head(rows_held)
        yield from best.values()

    back = spark.read.parquet(path).where(F.col("_cluster").isin(*stale)).select(id_col, vector, "_cluster")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in back.schema)
    order = Window.partitionBy("_cluster").orderBy(F.desc("_dist"), id_col)
    top = back.mapInPandas(farthest, f"{fields}, _dist double").withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= rows_held)
    found = top.toPandas()
    for c in stale:
        part = found[found["_cluster"] == c].sort_values("_nth")
        head = part.iloc[:held]
        unit = np.stack([_unit(v) for v in head[vector]]) if len(head) else np.zeros((0, 0))
        heads[c] = Head([int(i) for i in head[id_col]], unit, head["_dist"].to_numpy(dtype=float).copy())
        out = part.iloc[held:]
        limit[c] = (float(out["_dist"].iloc[0]), -int(out[id_col].iloc[0])) if len(out) else NOTHING
        bound[c] = float(part["_dist"].iloc[0]) if len(part) else 0.0


def _unit(values):
    x = np.asarray(values, dtype=float)
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


def core_set(
    vectors: DataFrame, per_part: int, id_col: str, vector: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Farthest-point picks of parts of about ``part_rows`` rows: a small set that covers the table.

    An md5 of the id deals rows to parts, and a part starts from its smallest id,
    so the set does not depend on how the table is stored. A task holds one part. The
    union of the local picks is a composable core-set: selecting from it stays within
    a constant factor of selecting from the whole table.
    """
    digits = DIGITS

    def local_picks(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(id_col, ignore_index=True)
        x = np.stack(part[vector].to_numpy()).astype(float)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n == 0, 1, n)
        picks = [0]
        distance = np.round(np.clip(1 - x @ x[0], 0, 2), digits)
        while len(picks) < min(per_part, len(x)):
            distance[picks] = -1
            picks.append(int(distance.argmax()))
            distance = np.minimum(distance, np.round(np.clip(1 - x @ x[picks[-1]], 0, 2), digits))
        return part.iloc[picks][[id_col, vector]]

    kept = _whole(vectors, id_col, vector)
    parts = max(1, -(-kept.count() // part_rows))
    key = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return kept.withColumn("_part", key % parts).groupBy("_part").applyInPandas(local_picks, kept.schema)


def farthest_points_coreset(
    vectors: DataFrame, k: int, id_col: str, vector: str, start_id: int, per_part: int | None = None
) -> DataFrame:
    """Approximate selection for a very large ``k``: the exact passes run over a core-set, made once, instead of the table."""
    start = _whole(vectors, id_col, vector).where(F.col(id_col) == start_id)
    covering = core_set(vectors.where(F.col(id_col) != start_id), per_part or k, id_col, vector)
    return farthest_points(settled(start.unionByName(covering), "core-set"), k, id_col, vector, start_id)


def radius(vectors: DataFrame, picks: DataFrame, id_col: str, vector: str, block: int = POOL) -> DataFrame:
    """Largest distance of any row to its nearest pick: what a selection achieves. Picks are scored in blocks."""
    rows = _whole(vectors, id_col, vector)
    chosen = rows.join(picks.select(id_col), id_col, "left_semi")
    blocks = max(1, -(-chosen.count() // block))
    chosen = settled(chosen.withColumn("_block", F.pmod(F.xxhash64(id_col), F.lit(blocks))), "picks")
    scored = rows.withColumn("_d", F.lit(None).cast("double"))
    for b in range(blocks):
        units = [_unit(row[0]).tolist() for row in chosen.where(F.col("_block") == b).select(vector).collect()]
        if units:
            scored = scored.withColumn("_d", F.least("_d", _min_distance(units)(F.col(vector))))
    return scored.agg(F.max("_d").alias("radius"))
