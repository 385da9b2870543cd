"""Operator 10: exact top-k inner products by a dual-tree search over cover trees.

1. A bounded sample (``SAMPLE`` rows by hash) gives pivots by farthest-first choice, the top
   level of the tree. Every row goes to the cell of its nearest pivot; a cell keeps its
   radius and is split by a hash into blocks of about ``BLOCK`` rows, so a cell of very many
   (or equal) vectors is many blocks. Each query gets its k-th best score over the sample.
2. Each query is searched in the cell that promises most, which raises its k-th score, and
   then only in those cells whose bound ``q . pivot + |q| * radius`` still reaches it.
3. In a block, rows and the queries sent there are indexed by cover trees: a node's children
   are a net of centres, farthest first, up to half its radius apart. Pairs of nodes
   are visited from the most promising on; a pair is dropped when no inner product in it
   can reach the worst k-th score of the query group: ``c_q . c_r + R_q |c_r| + R_r |c_q| +
   R_q R_r`` bounds them all. In a leaf each point is bounded before it is scored.

A block's rows are shuffled to one task, which builds their tree once and takes its queries
in parts of ``QUERIES``; a window keeps the best k of each query. On the driver are the
sample, and one row a cell, of which there are at most ``CELLS``.

Nulls: vectors that are null or hold null or non-finite components take no part, nor do
null ids. Shorter vectors count as padded with zeros. A row is the query's own if it has
its id, so repeated rows of a query are left out for it, and other repeated rows are each
a candidate; a query id with several vectors gets the best of all of them. Ties go to the
smaller vec_id. An empty table gives no rows; other columns are ignored, whatever their
names. Scores are exact where they and the scaled components fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SAMPLE = 4096
CELLS = 256
BLOCK = 8192
QUERIES = 2048
FAN = 32
LEAF, QUERY_LEAF = 64, 16
NONE = np.iinfo(np.int64).min
FOUND = "query_id long, vec_id long, score long"
FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def slack(b):
    """``b`` raised by more than sums in floating point may be off."""
    return b + 1e-9 * np.abs(b) + 1e-6


class Node:
    __slots__ = ("center", "norm", "radius", "kids", "points", "worst", "done")

    def __init__(self, center, radius, kids, points, worst):
        self.center, self.radius, self.kids, self.points, self.worst = center, radius, kids, points, worst
        self.norm, self.done = float(np.linalg.norm(center)), None


def cover_tree(x: np.ndarray, rows: np.ndarray, leaf: int, floors: np.ndarray | None = None) -> Node:
    """Tree over ``x[rows]`` with ``x[rows[0]]`` as its centre; ``floors``: k-th scores that
    the rows are known to have. Children are a net of centres, farthest first, until all
    rows lie within half the radius of one, or ``FAN`` centres; each row goes to its nearest."""
    center, worst = x[rows[0]], int(floors[rows].min()) if floors is not None else NONE
    away = np.linalg.norm(x[rows] - center, axis=1)
    radius = float(away.max())
    if len(rows) <= leaf or radius == 0:
        return Node(center, radius, [], rows, worst)
    picks, nearest, fan = [0], np.zeros(len(rows), np.int64), min(FAN, -(-2 * len(rows) // leaf))
    while len(picks) < 2 or (len(picks) < fan and away.max() > radius / 2):
        picks.append(int(away.argmax()))
        d = np.linalg.norm(x[rows] - x[rows[picks[-1]]], axis=1)
        nearest[d < away] = len(picks) - 1
        away = np.minimum(away, d)
    kids = []
    for j, pick in enumerate(picks):
        nearest[pick] = -1
        kids.append(cover_tree(x, np.append(rows[pick], rows[nearest == j]), leaf, floors))
    return Node(center, radius, kids, None, worst)


def bound(q: Node, r: Node) -> float:
    """No inner product between points of the nodes is larger."""
    return slack(float(q.center @ r.center) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius)


class Search:
    """Best k of ``r`` (ids ``r_ids``) for each row of ``q`` among those that reach its floor."""

    def __init__(self, q, q_ids, floors, r, r_ids, k, tree=None):
        self.q, self.q_ids, self.r, self.r_ids, self.k = q, q_ids, r, r_ids, k
        self.floors, self.tree, self.scored = floors, tree, 0
        self.score = np.full((len(q), k), NONE)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.norms = np.linalg.norm(r, axis=1)
        self.exact = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * q.shape[1] < 2**53

    def products(self, rows, points) -> np.ndarray:
        """Integer inner products: in floating point where that is exact, else in 64-bit
        integers, where sums that fit at the end may overflow on the way."""
        q, r = self.q[rows], self.r[points]
        return (q @ r.T).astype(np.int64) if self.exact else q.astype(np.int64) @ r.astype(np.int64).T

    def leaf(self, a: Node, b: Node) -> None:
        points, rows = b.points, a.points
        points = points[slack(self.r[points] @ a.center + a.radius * self.norms[points]) >= a.worst]
        if not len(points):
            return
        self.scored += len(rows) * len(points)
        s = self.products(rows, points)
        s[self.q_ids[rows][:, None] == self.r_ids[points][None, :]] = NONE
        keep = (s >= np.maximum(self.score[rows, -1], self.floors[rows])[:, None]).any(axis=0)  # ties with the k-th stay
        s, points = s[:, keep], points[keep]
        s = np.concatenate([self.score[rows], s], axis=1)
        ids = np.concatenate([self.found[rows], np.broadcast_to(self.r_ids[points], (len(rows), len(points)))], axis=1)
        ids = np.where(s == NONE, np.iinfo(np.int64).max, ids)
        # descending scores: ~s orders integers as -s would, without overflow
        order = np.lexsort((ids, ~s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.found[rows] = np.take_along_axis(ids, order, 1)
        a.worst = max(a.worst, int(np.maximum(self.score[rows, -1], self.floors[rows]).min()))

    def seed(self, a: Node, b: Node) -> None:
        """Score each query leaf with the leaf that promises most, so that the visit starts
        with k-th scores of its own."""
        for kid in a.kids:
            self.seed(kid, b)
        if a.kids:
            a.worst = max(a.worst, min(kid.worst for kid in a.kids))
            return
        while b.kids:
            b = max(b.kids, key=lambda x: bound(a, x))
        self.leaf(a, b)
        a.done = b

    def visit(self, a: Node, b: Node) -> None:
        if bound(a, b) < a.worst or a.done is b:
            return
        if not a.kids and not b.kids:
            self.leaf(a, b)
        elif b.kids and (not a.kids or b.radius >= a.radius):
            for kid in sorted(b.kids, key=lambda x: -bound(a, x)):
                self.visit(a, kid)
        else:
            for kid in a.kids:
                self.visit(kid, b)
            a.worst = max(a.worst, min(kid.worst for kid in a.kids))

    def run(self):
        if len(self.q) and len(self.r):
            tree = self.tree or cover_tree(self.r, np.arange(len(self.r)), LEAF)
            queries = cover_tree(self.q, np.arange(len(self.q)), QUERY_LEAF, self.floors)
            self.seed(queries, tree)
            self.visit(queries, tree)
        hit = (self.score != NONE) & (self.score >= self.floors[:, None])
        return np.repeat(self.q_ids, hit.sum(axis=1)), self.found[hit], self.score[hit]


def matrix(column) -> np.ndarray:
    """Rows of floor(1024 * x), padded with zeros to one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(1024 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def same_width(*parts: np.ndarray) -> list[np.ndarray]:
    d = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, d - p.shape[1]))) for p in parts]


def pivots_of(x: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first choice of up to ``most`` distinct rows."""
    picks, away = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picks) < most and away.max() > 0:
        picks.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(x - x[picks[-1]], axis=1))
    return x[picks]


def dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, embedding, cell (nearest pivot) and away (distance from it)."""
    kind = rows.schema["embedding"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x, p = same_width(matrix(batch.column("embedding")), pivots)
            cell = (np.einsum("ij,ij->i", p, p)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
            away = slack(np.linalg.norm(x - p[cell], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(away)], ["vec_id", "embedding", "cell", "away"])

    return rows.mapInArrow(run, f"vec_id long, embedding {kind}, cell int, away double")


def routed(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, first_block: np.ndarray, home: bool) -> DataFrame:
    """Queries (vec_id, embedding, floor, home) once for each block they are to be searched
    in: those of their home cell, or those of other cells whose bound reaches their floor."""
    kind = queries.schema["embedding"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            q, p = same_width(matrix(batch.column("embedding")), pivots)
            floors, own = batch.column("floor").to_numpy(), batch.column("home").to_numpy()
            if home:
                go = own[:, None] == np.arange(len(p))[None, :]
            else:
                go = slack(q @ p.T + np.linalg.norm(q, axis=1)[:, None] * radius[None, :]) >= floors[:, None]
                go[np.arange(len(q)), own] = False
            blocks = [[b for c in np.flatnonzero(row) for b in range(first_block[c], first_block[c + 1])] for row in go]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "embedding", "floor", "home")), pa.array(blocks, pa.list_(pa.int32()))], ["vec_id", "embedding", "floor", "home", "blocks"])

    sent = queries.mapInArrow(run, f"vec_id long, embedding {kind}, floor long, home int, blocks array<int>")
    return sent.select(F.explode("blocks").alias("block"), F.lit(1).alias("kind"), "home", "vec_id", "embedding", "floor")


def searched(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of each block for each query sent there that reach the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ids, data = None, [], [], None

        def found(batch):
            nonlocal data
            if data is None and parts:
                r = np.concatenate(same_width(*parts))
                data = (r, np.concatenate(ids), cover_tree(r, np.arange(len(r)), LEAF))
            if data is None:
                return
            q, r = same_width(matrix(batch.column("embedding")), data[0])
            tree = data[2] if r.shape[1] == data[0].shape[1] else None
            rows = Search(q, batch.column("vec_id").to_numpy(), batch.column("floor").to_numpy(), r, data[1], k, tree).run()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], schema=FOUND_SCHEMA)

        for batch in batches:
            # runs of one block and kind: candidates first, then queries by home cell
            keys = batch.column("block").to_numpy() * 2 + batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if keys[a] >> 1 != block:
                    block, parts, ids, data = keys[a] >> 1, [], [], None
                if keys[a] & 1:
                    for at in range(a, b, QUERIES):
                        yield from found(batch.slice(at, min(QUERIES, b - at)))
                else:
                    parts.append(matrix(batch.column("embedding").slice(a, b - a)))
                    ids.append(batch.column("vec_id").slice(a, b - a).to_numpy())

    rows = candidates.unionByName(queries).repartition("block").sortWithinPartitions("block", "kind", "home")
    return rows.mapInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, query_modulus: int = 100, block: int = BLOCK, least_blocks: int = 64, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not seen.num_rows:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    near, near_ids = matrix(seen.column("embedding")), seen.column("vec_id").to_numpy()
    pivots = pivots_of(near, CELLS)
    cells = staged(dealt(rows, pivots), "top-k-cells")
    stats = {r.cell: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # at most CELLS rows
    count = np.array([stats[c].n if c in stats else 0 for c in range(len(pivots))])
    radius = np.array([stats[c].radius if c in stats else 0.0 for c in range(len(pivots))])
    most = min(block, -(-int(count.sum()) // least_blocks))
    first_block = np.concatenate([[0], np.cumsum(-(-count // most))]).astype(np.int32)
    base, parts = (F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1) for values in (first_block[:-1], np.maximum(1, np.diff(first_block))))
    candidates = cells.select((base + F.pmod(F.xxhash64("vec_id"), parts)).cast("int").alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("home"), "vec_id", "embedding", F.lit(NONE).alias("floor"))

    def first_floors(batches):
        for batch in batches:
            q, r, p = same_width(matrix(batch.column("embedding")), near, pivots)
            ids = batch.column("vec_id").to_numpy()
            floors = np.full(len(q), NONE)
            for a in range(0, len(q), 256):
                s = Search(q[a : a + 256], ids[a : a + 256], floors[a : a + 256], r, near_ids, k)
                s = np.where(ids[a : a + 256, None] == near_ids[None, :], NONE, s.products(slice(None), slice(None)))
                if s.shape[1] >= k:
                    floors[a : a + 256] = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
            promise = np.where(count[None, :] > 0, q @ p.T + np.linalg.norm(q, axis=1)[:, None] * radius[None, :], -math.inf)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(floors), pa.array(promise.argmax(axis=1).astype(np.int32))], ["vec_id", "embedding", "floor", "home"])

    kind = rows.schema["embedding"].dataType.simpleString()
    queries = staged(rows.filter(F.col("vec_id") % query_modulus == 0).mapInArrow(first_floors, f"vec_id long, embedding {kind}, floor long, home int"), "top-k-queries")
    found = staged(best_of(searched(candidates, routed(queries, pivots, radius, first_block, True), k), k).drop("rank"), "top-k-home")
    reached = best_of(found, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    raised = queries.join(reached, "vec_id", "left").select("vec_id", "embedding", F.greatest("floor", "reached").alias("floor"), "home")
    others = searched(candidates, routed(raised, pivots, radius, first_block, False), k)
    return best_of(found.unionByName(others), k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.x, r.x) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
