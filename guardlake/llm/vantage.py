"""Approximate nearest neighbours by cosine: vantage-point trees per shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from guardlake.llm.common import bounded_batches
from guardlake.session import settled

#: A subtree is left out when its least possible distance, times this, exceeds the kth distance. 1 searches exactly.
STRETCH = 5.0
#: Rows of a shard and of a tree's leaf, queries that meet a shard in one task, rows that the cells are fitted on, about.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES, SAMPLE_ROWS = 8_192, 128, 2_048, 16_384
#: Rows of the sample behind a cell, at least: cells number at most SAMPLE_ROWS / CELL_SAMPLE.
CELL_SAMPLE = 16
#: Rounding of products and of distances, allowed for in every comparison of bounds.
NEAR_SCORE, NEAR = 1e-12, 1e-7


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` with components as doubles; rows go that have no id, no vector, a null or non-finite component, or
    only zeros."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite & F.exists(v, lambda c: c != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """The vectors of a list column, scaled by a power of two each, so that no square leaves the doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -power)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def away(cosine: np.ndarray) -> np.ndarray:
    """The distance of unit vectors of such a product; it obeys the triangle inequality."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Cells:
    """A vantage tree over a sample; its leaves are cells that every vector belongs to exactly one of."""

    def __init__(self, x: np.ndarray, cells: int) -> None:
        self.point, self.radius, self.child, self.cells = [], [], [], 0
        self.root = self._grow(x, cells)

    def _grow(self, x: np.ndarray, cells: int) -> int:
        """A node, or a cell as ``-1 - number``."""
        if cells > 1 and len(x) > 2 * CELL_SAMPLE:
            point = x[away(x @ x[0]).argmax()]
            far = away(x @ point)
            radius = float(np.median(far))
            inner = far <= radius
            if not inner.all():
                node = len(self.point)
                self.point.append(point)
                self.radius.append(radius)
                self.child.append(None)
                self.child[node] = self._grow(x[inner], cells - cells // 2), self._grow(x[~inner], cells // 2)
                return node
        self.cells += 1
        return -self.cells

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                out[who] = -1 - node
            elif len(who):
                inner = away(x[who] @ self.point[node]) <= self.radius[node]
                todo += [(self.child[node][0], who[inner]), (self.child[node][1], who[~inner])]
        return out

    def within(self, x: np.ndarray, reach: np.ndarray, stretch: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``x``, cell) that may hold something nearer than ``reach``."""
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                rows.append(who)
                cells.append(np.full(len(who), -1 - node, dtype=np.int32))
            elif len(who):
                beyond = away(x[who] @ self.point[node]) - self.radius[node]
                limit = reach[who] + NEAR
                todo.append((self.child[node][0], who[stretch * beyond <= limit]))
                todo.append((self.child[node][1], who[stretch * -beyond <= limit]))
        return np.concatenate(rows), np.concatenate(cells)


class Tree:
    """Nodes over unit vectors in preorder: vantage row, least and greatest distance of either half, row range."""

    def __init__(self, unit: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(unit))
        self.point, self.bounds, self.child, self.range = [], [], [], []
        todo = [(0, len(unit), -1, 0)]
        while todo:
            low, high, up, side = todo.pop()
            node = len(self.point)
            if up >= 0:
                self.child[up][side] = node
            self.range.append((low, high))
            self.child.append([-1, -1])
            rows = self.order[low:high]
            if high - low <= leaf_rows:
                self.point.append(-1)
                self.bounds.append((0.0, 0.0, 0.0, 0.0))
                continue
            point = rows[away(unit[rows] @ unit[rows[0]]).argmax()]
            far = away(unit[rows] @ unit[point])
            by = far.argsort(kind="stable")
            far, mid = far[by], (high - low) // 2
            self.order[low:high] = rows[by]
            self.point.append(int(point))
            self.bounds.append((far[0], far[mid - 1], far[mid], far[-1]))
            todo += [(low + mid, high, node, 1), (low, low + mid, node, 0)]

    def stored(self) -> dict[str, list]:
        return {
            "row_order": [self.order.tolist()], "point": [self.point], "bounds": [[float(b) for four in self.bounds for b in four]],
            "child": [[c for two in self.child for c in two]], "low_high": [[r for two in self.range for r in two]],
        }

    @classmethod
    def read(cls, row: dict) -> Tree:
        tree = cls.__new__(cls)
        tree.order = np.array(row["row_order"])
        tree.point, tree.bounds = row["point"], list(zip(*[iter(row["bounds"])] * 4))
        tree.child, tree.range = list(zip(*[iter(row["child"])] * 2)), list(zip(*[iter(row["low_high"])] * 2))
        return tree


class Nearest:
    """The k best rows so far of each query: scores falling, equal scores by rising id; ``kth`` is the score to reach."""

    def __init__(self, k: int, kth: np.ndarray) -> None:
        self.k, self.kth = k, kth.copy()
        self.score = [np.zeros(0)] * len(kth)
        self.id = [np.zeros(0, np.int64)] * len(kth)

    def offer(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[query], score]), np.concatenate([self.id[query], ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.score[query], self.id[query] = score[best], ids[best]
        if len(best) == self.k:
            self.kth[query] = max(self.kth[query], score[best[-1]])


def search_tree(
    tree: Tree, x: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray, found: Nearest, stretch: float,
) -> int:
    """Offers a shard's rows to the queries; a row of the query's own id is none of its answers. Gives the pairs scored.

    Queries go down in groups, the half of the lower bound first. Rows that reach the kth score by matrix product are scored
    one by one, so that equal vectors get equal scores wherever they lie.
    """
    long, asked_long = lengths(x), lengths(asked)
    unit, q = x / long[:, None], asked / asked_long[:, None]
    scored = 0
    todo = [(0, np.arange(len(q)), np.zeros(len(q)))]
    while todo:
        node, who, least = todo.pop()
        near = stretch * least <= away(np.maximum(found.kth[who], -1)) + NEAR
        who, least = who[near], least[near]
        if not len(who):
            continue
        if tree.point[node] < 0:
            rows = tree.order[slice(*tree.range[node])]
            scored += len(who) * len(rows)
            rough = q[who] @ unit[rows].T
            fits = (rough >= found.kth[who][:, None] - NEAR_SCORE) & (ids[rows][None, :] != own[who][:, None])
            for i in np.flatnonzero(fits.any(axis=1)).tolist():
                query = who[i]
                at = fits[i]
                if at.sum() > 4 * found.k:
                    at = at & (rough[i] >= np.partition(rough[i][at], -found.k)[-found.k] - NEAR_SCORE)
                at = rows[at]
                exact = (x[at] * asked[query]).sum(axis=1) / (long[at] * asked_long[query])
                found.offer(query, exact, ids[at])
            continue
        far = away(q[who] @ unit[tree.point[node]])
        in_low, in_high, out_low, out_high = tree.bounds[node]
        inner = np.maximum(least, np.maximum(far - in_high, in_low - far))
        outer = np.maximum(least, np.maximum(far - out_high, out_low - far))
        left, right = tree.child[node]
        first = inner <= outer
        todo += [  # the last entry is visited first
            (left, who[~first], inner[~first]), (right, who[first], outer[first]),
            (right, who[~first], outer[~first]), (left, who[first], inner[first]),
        ]
    return scored


def build_shards(rows: DataFrame) -> DataFrame:
    """One row per shard: the tree, ids and vectors (a row once per copy) of its rows."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        width = key[0].as_py()
        table = table.sort_by([("id", "ascending")])
        copies = table.column("n").to_numpy()
        x = np.repeat(matrix(table.column("v"), width), copies, axis=0)
        ids = np.repeat(table.column("id").to_numpy(), copies)
        tree = Tree(x / lengths(x)[:, None])
        named = {n: pa.array([k.as_py()], pa.int32()) for n, k in zip(("width", "cell", "part"), key)}
        return pa.table({**named, "ids": pa.array([ids]), "x": pa.array([x.tobytes()], pa.binary()), **{
            n: pa.array(v, pa.list_(pa.float64() if n == "bounds" else pa.int32())) for n, v in tree.stored().items()
        }})

    schema = (
        "width int, cell int, part int, ids array<long>, x binary, row_order array<int>, point array<int>,"
        " bounds array<double>, child array<int>, low_high array<int>"
    )
    return rows.groupBy("width", "cell", "part").applyInArrow(build, schema)


def visit(visits: DataFrame, shards: DataFrame, k: int, stretch: float) -> DataFrame:
    """``(query_id, vec_id, score)``: the best k of each shard for the queries ``(id, v, kth)`` that visit it."""
    keys = ["width", "cell", "part", "block"]
    met = visits.select(*[F.col(c).alias(f"to_{c}") for c in keys]).distinct()
    same = [F.col(c) == F.col(f"to_{c}") for c in keys[:3]]
    copies = shards.join(met, same[0] & same[1] & same[2]).drop(*keys[:3])

    def run(key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
        width = key[0].as_py()
        if not len(asked) or not len(shard):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row = shard.drop_columns(["x", "ids"]).to_pylist()[0]
        x = np.frombuffer(shard.column("x")[0].as_py()).reshape(-1, width)
        ids = np.array(shard.column("ids")[0].values)
        own = asked.column("id").to_numpy()
        found = Nearest(k, asked.column("kth").to_numpy())
        search_tree(Tree.read(row), x, ids, matrix(asked.column("v"), width), own, found, stretch)
        number = [len(s) for s in found.score]
        return pa.table({
            "query_id": np.repeat(own, number), "vec_id": np.concatenate(found.id), "score": np.concatenate(found.score),
        })

    asked = visits.select(*keys, "id", "v", "kth").groupBy(*keys)
    return asked.cogroup(copies.groupBy(*[f"to_{c}" for c in keys])).applyInArrow(run, "query_id long, vec_id long, score double")


def routed(rows: DataFrame, shared, every: bool, stretch: float = 1.0) -> DataFrame:
    """``rows`` with width and cell: the one a row belongs to, or with ``every`` all others it has to visit (by ``kth``)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            column = batch.column(names.index("v"))
            width = pa.compute.list_value_length(column).to_numpy()
            for w in np.unique(width).tolist():
                part = batch.filter(pa.array(width == w))
                x = matrix(part.column(names.index("v")), w)
                unit = x / lengths(x)[:, None]
                tree = cells.get(w)
                home = tree.home(unit) if tree else np.zeros(len(x), np.int32)
                if every:
                    if not tree:
                        continue
                    at, cell = tree.within(unit, away(np.maximum(part.column(names.index("kth")).to_numpy(), -1)), stretch)
                    other = cell != home[at]
                    at, cell = at[other], cell[other]
                    step = max(1, (4 << 20) // (8 * w))
                    for begin in range(0, len(at), step):
                        yield named(part.take(pa.array(at[begin : begin + step])), w, cell[begin : begin + step])
                else:
                    yield named(part, w, home)

    def named(part: pa.RecordBatch, width: int, cell: np.ndarray) -> pa.RecordBatch:
        columns = [*part.columns, pa.array(np.full(len(cell), width, np.int32)), pa.array(cell)]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "width", "cell"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, width int, cell int")


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int = 5, stretch: float = STRETCH, shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k rows of largest cosine that the search finds.

    Both inputs are ``(id, v)`` as ``usable`` gives them; only vectors of one width are compared. A row of the query's own id
    is no answer, ties go to the smaller id, repeated rows count each. Of several vectors under one query id the
    least is asked. Of equal vectors only the k + 1 smallest ids can be answers, so only these are indexed: a group of
    copies of any size is a few rows.

    Cells are the leaves of a vantage tree over a sample of about ``sample_rows``; every row goes to its cell, a cell
    of many rows to several shards, and each shard's tree is built once and written. A query first searches its own
    cell; the kth score found there bounds the cells it visits next and where it starts in them. ``stretch`` 1 makes the
    answers exact; larger values prune more. Without candidates or queries there are no rows.
    """
    spark = candidates.sparkSession
    bounded_batches(spark)
    same = F.xxhash64("v")
    counted = candidates.groupBy(same.alias("h"), "v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    by_vector = Window.partitionBy("h", "v").orderBy("id")
    few = counted.withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1)
    few = settled(few.select("id", "v", "n", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 30)).alias("draw")), "vectors")
    number = few.count()
    sample = few.where(F.col("draw") < int((1 << 30) * min(1.0, sample_rows / max(1, number)))).select("v").toPandas()["v"]
    by_width: dict[int, list] = {}
    for v in sample:
        by_width.setdefault(len(v), []).append(v)
    cells = {}
    for width, held in by_width.items():
        x = matrix(pa.array(held, pa.list_(pa.float64())), width)
        cells[width] = Cells(x / lengths(x)[:, None], max(1, 2 * number * len(held) // (len(sample) * shard_rows)))
    shared = spark.sparkContext.broadcast(cells)

    placed = settled(routed(few.select("id", "v", "n"), shared, every=False), "cells")
    parts = placed.groupBy("width", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    parts = settled(parts, "cell_parts")
    dealt = placed.join(parts, ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    shards = settled(build_shards(dealt.select("width", "cell", "part", "id", "n", "v")), "shards")

    asked = settled(queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("kth", F.lit(-2.0)), "queries")
    blocks = max(1, -(-asked.count() // block_queries))

    def spread(visits: DataFrame) -> DataFrame:
        """A query meets every part of a cell, together with queries of its block."""
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        return visits.join(parts, ["width", "cell"]).select("*", block.alias("block"), every.alias("part"))

    first = best_of(visit(spread(routed(asked, shared, every=False)), shards, k, stretch), k)
    first = settled(first, "home_answers")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("found"))
    known = asked.drop("kth").join(kth, "id", "left").select("id", "v", F.coalesce("found", F.lit(-2.0)).alias("kth"))
    more = visit(spread(settled(routed(known, shared, every=True, stretch=stretch), "visits")), shards, k, stretch)
    return best_of(first.drop("rank").unionByName(more), k)


def best_of(rows: DataFrame, k: int) -> DataFrame:
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
