"""Exact top-k inner-product search with ball trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from guardlake.session import settled

#: Vectors of a shard and of a tree's leaf, queries of a block, about.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 8_192, 256, 4_096
SCALE = 1_024
#: Columns of a stored tree.
TREE = ("row_order", "centre", "radius", "low_high", "child")
#: Largest integer up to which sums of products are exact in doubles.
EXACT = 2**53


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, v)``: components as floor(scale * x) in double arithmetic; rows go that have no id, no vector, or a
    null or non-finite component."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("id"), whole.alias("v"))


class BallTree:
    """Nodes over rows of ``x`` (doubles holding integers): centre, radius, row range, children."""

    def __init__(self, x: np.ndarray, leaf_rows: int) -> None:
        self.order = np.arange(len(x))
        self.centre, self.radius, self.range, self.child = [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            low, high, up = todo.pop()
            part = x[self.order[low:high]]
            centre = part.mean(axis=0)
            away = ((part - centre) ** 2).sum(axis=1)
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(away.max())) * (1 + 1e-9))
            self.range.append((low, high))
            self.child.append([])
            if up >= 0:
                self.child[up].append(node)
            if high - low > leaf_rows and away.max() > 0:
                one = part[away.argmax()]
                two = part[((part - one) ** 2).sum(axis=1).argmax()]
                side = (part @ (two - one)).argsort(kind="stable")
                self.order[low:high] = self.order[low:high][side]
                mid = (low + high) // 2
                todo += [(mid, high, node), (low, mid, node)]
        self.centre = np.array(self.centre).reshape(-1, x.shape[1])
        self.radius = np.array(self.radius)

    def stored(self) -> dict[str, bytes]:
        """The tree as bytes; a leaf's children are -1."""
        child = np.array([c or [-1, -1] for c in self.child], dtype=np.int64)
        parts = (self.order.astype(np.int64), self.centre, self.radius, np.array(self.range, dtype=np.int64), child)
        return dict(zip(TREE, (p.tobytes() for p in parts)))

    @classmethod
    def read(cls, parts: dict[str, bytes], width: int) -> BallTree:
        tree = cls.__new__(cls)
        tree.order, tree.radius = np.frombuffer(parts["row_order"], np.int64), np.frombuffer(parts["radius"])
        tree.centre = np.frombuffer(parts["centre"]).reshape(-1, width) if width else np.zeros((len(tree.radius), 0))
        tree.range = np.frombuffer(parts["low_high"], np.int64).reshape(-1, 2).tolist()
        tree.child = [c if c[0] >= 0 else [] for c in np.frombuffer(parts["child"], np.int64).reshape(-1, 2).tolist()]
        return tree


class Best:
    """The k best rows so far of each query: scores falling, equal scores by rising id."""

    def __init__(self, n: int, k: int, kth: np.ndarray) -> None:
        self.k, self.kth = k, kth.copy()
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of some rows against some queries; a row is no answer to the query of its own id."""
        fits = (scores >= self.kth[queries][:, None]) & (ids[None, :] != own[queries][:, None])
        for j in np.flatnonzero(fits.any(axis=1)).tolist():
            q = queries[j]
            s = np.concatenate([self.score[q], scores[j, fits[j]]])
            i = np.concatenate([self.id[q], ids[fits[j]]])
            if len(s) > 4 * self.k:
                cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i = s[s >= cut], i[s >= cut]
            first = np.lexsort((i, -s))[: self.k]
            self.score[q], self.id[q] = s[first], i[first]
            self.kth[q] = max(self.kth[q], s[first[-1]] if len(first) == self.k else -np.inf)


def branch_and_bound(
    x: np.ndarray, ids: np.ndarray, tree: BallTree, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int, greedy: bool,
) -> Best:
    """The best rows of a shard for all queries, those below a query's ``kth`` left out.

    A node's bound for a query is its centre's product plus radius times the query's length. Queries travel down in
    groups: each visits the child of the higher bound first, and leaves a node whose bound is below its current
    kth score. ``greedy`` only follows each query to its best leaf.
    """
    found = Best(len(q), k, kth)
    length = np.sqrt((q**2).sum(axis=1))
    slack = 1e-9 * (1 + length * np.sqrt((x**2).sum(axis=1).max(initial=0.0)))
    bound = lambda node, who: q[who] @ tree.centre[node] + length[who] * tree.radius[node] + slack[who]
    todo = [(0, np.arange(len(q)))]
    while todo:
        node, who = todo.pop()
        if not greedy:
            who = who[bound(node, who) >= found.kth[who]]
        if not len(who):
            continue
        if not tree.child[node]:
            low, high = tree.range[node]
            rows = tree.order[low:high]
            for begin in range(0, len(rows), 4 * LEAF_ROWS):
                part = rows[begin : begin + 4 * LEAF_ROWS]
                found.offer(who, q[who] @ x[part].T, ids[part], own)
            continue
        left, right = tree.child[node]
        prefers = bound(left, who) >= bound(right, who)
        if greedy:
            todo += [(left, who[prefers]), (right, who[~prefers])]
        else:  # the last entry is visited first
            todo += [(left, who[~prefers]), (right, who[prefers]), (right, who[~prefers]), (left, who[prefers])]
    return found


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k largest integer inner products over all candidates.

    Both inputs are ``(id, v)`` with long vectors; a candidate with the query's own id is left out, ties go to the smaller
    id. Candidates are dealt to shards of about ``shard_rows``; the ball tree of each is built once and written. Queries are
    dealt to blocks of a fixed size, and every block meets every shard in a task of its own: first each query only follows
    a tree to its best leaf, and the k-th best of all shards together, kept in files, is the score that every shard
    starts from in the full sweep. Repeated queries give one answer, of several vectors under one id that of
    the least; repeated candidates one row each. Without candidates or queries there are no rows. Only vectors of one width
    are compared; a product sum of 2^53 or more, which doubles cannot hold exactly, raises an error.
    """
    shards = max(1, -(-candidates.count() // shard_rows))
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    trees = settled(build_trees(candidates.select("id", "v", shard.alias("shard"), F.size("v").alias("width"))), "trees")
    asked = settled(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // block_queries))
    asked = asked.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "width": F.size("v")})
    first = best_of(sweep(trees, asked.withColumn("kth", F.lit(float("-inf"))), shards, blocks, k, greedy=True), k)
    seeds = settled(first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth")), "seeds")
    started = asked.join(seeds, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    return best_of(sweep(trees, started, shards, blocks, k, greedy=False), k)


def build_trees(dealt: DataFrame) -> DataFrame:
    """One row per shard and width: ids, vectors and ball tree."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        width = key[1].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        tree = BallTree(x.astype(np.float64), LEAF_ROWS).stored()
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()),
            "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "x": pa.array([x.astype(np.int64).tobytes()], pa.binary()), **{n: pa.array([b], pa.binary()) for n, b in tree.items()},
        })

    schema = "shard int, width int, ids binary, x binary, " + ", ".join(f"{n} binary" for n in TREE)
    return dealt.groupBy("shard", "width").applyInArrow(build, schema)


def sweep(trees: DataFrame, asked: DataFrame, shards: int, blocks: int, k: int, greedy: bool) -> DataFrame:
    """Every shard's best rows for every block of queries ``(id, v, width, block, kth)``."""

    def run(key: tuple, rows: pa.Table, tree: pa.Table) -> pa.Table:
        width = key[1].as_py()
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not len(rows) or not len(tree):
            return none
        parts = tree.to_pylist()[0]
        ids = np.frombuffer(parts["ids"], np.int64)
        x = np.frombuffer(parts["x"], np.int64).reshape(len(ids), width).astype(np.float64)
        own = rows.column("id").to_numpy().astype(np.int64)
        q = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), width).astype(np.float64)
        if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, width) >= EXACT:
            raise ValueError("components too large for exact scores")
        found = branch_and_bound(x, ids, BallTree.read(parts, width), q, own, rows.column("kth").to_numpy(), k, greedy)
        at, col = np.nonzero(np.isfinite(found.score))
        return pa.table({
            "query_id": pa.array(own[at]), "vec_id": pa.array(found.id[at, col]),
            "score": pa.array(found.score[at, col].astype(np.int64)),
        })

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", "kth", "block", "width", every(shards).alias("shard"))
    right = trees.select("*", every(blocks).alias("to_block")).withColumnsRenamed({"shard": "of_shard", "width": "of_width"})
    met = left.groupBy("shard", "width", "block").cogroup(right.groupBy("of_shard", "of_width", "to_block"))
    return met.applyInArrow(run, "query_id long, vec_id long, score long")


def best_of(rows: DataFrame, k: int) -> DataFrame:
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def divisible(id_column: Column, by: int = 100) -> Column:
    return id_column % by == 0
