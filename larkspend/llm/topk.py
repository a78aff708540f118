"""Exact top-k inner-product search with dual-tree search over cover trees.

Vectors are quantised to integers. The top of the data's cover tree is a bounded number of pivots, chosen far from each
other in a bounded sample; each vector belongs to the cell of its nearest pivot, and each cell's size, covering radius
and largest norm are exact. Each query first meets one block of its own cell, which seeds its kth score; then it goes
only to the cells where the largest inner product that pivot, radius and norms allow reaches that score. A cell's rows
are cut into blocks of bounded size. A task reads a block, builds its cover tree once and takes the queries that come to
it in groups: it builds a tree over each group and walks both trees together, dropping a pair of nodes when the largest
inner product between them is below the worst kth score of the group's queries.

The sample only places pivots: every vector is in a cell, and results are exact wherever they lie. Where vectors have no
clusters (random directions), no bound can drop a cell and every pair is compared, block by block.

Defined results: vectors that are null or hold a null or non-finite component, and rows without a vec_id, take no part;
vectors of different lengths are never compared; a query never meets its own row, but other rows of its vec_id; rows that
repeat a vec_id each count; of several query rows with one vec_id each asks, and has its own ranks; equal scores go to the smaller
vec_id; with fewer than k candidates all are returned; an empty table gives no rows; extra columns are ignored. Scores
are exact while length * max|component|^2 stays below 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import checkpoint

SCALE = 1024
K = 10
QUERY_EVERY = 100
DATA_BLOCK = 4096
QUERY_BLOCK = 512
#: Vectors from which pivots are chosen, and pivots at most.
SAMPLE = 4096
PIVOTS = 512
#: Queries that meet a block in one task; more are dealt to several copies of it.
QUERIES_A_TASK = 1 << 16
LEAF = 48
BASE = 1.25


class Node:
    __slots__ = ("centre", "children", "norm", "points", "radius", "top")

    def __init__(self, centre: np.ndarray, points: np.ndarray, radius: float, top: float):
        self.centre, self.points, self.radius, self.top = centre, points, radius, top
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[Node] = []


def largest_product(product, norm_a, radius_a, top_a, norm_b, radius_b, top_b):
    """At least the largest inner product of a point of one ball with one of another, from their centres' inner product
    and norms, their radii, and the largest norms in them; for numbers or arrays. Two bounds hold: one from the radii, and
    one from how far the balls are apart."""
    near = product + radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    gap = np.maximum(0.0, np.sqrt(np.maximum(0.0, norm_a * norm_a + norm_b * norm_b - 2 * product)) - radius_a - radius_b)
    far = (top_a * top_a + top_b * top_b - gap * gap) / 2
    return np.minimum(near, far) + 1e-9 * (np.abs(product) + (norm_a + radius_a) * (norm_b + radius_b) + top_a * top_a + top_b * top_b) + 1e-6


def cover_tree(x: np.ndarray, points: np.ndarray, centre: int) -> Node:
    """Each node's children have centres at least radius / BASE apart, the first being the node's own, and cover its
    points within that distance; points that end up alone are gathered in leaves."""
    distance = np.sqrt(((x[points] - x[centre]) ** 2).sum(1))
    top = lambda own: float(np.sqrt((x[own] ** 2).sum(1).max(initial=0.0)))
    node = Node(x[centre], points, float(distance.max(initial=0.0)), top(points))
    if len(points) <= LEAF or node.radius == 0:
        return node
    reach = node.radius / BASE
    rest, near, groups, single = points, distance, [], []
    middle = centre
    while len(rest):
        inside = near <= reach
        own = rest[inside]
        (groups if len(own) > LEAF // 4 else single).append((middle, own))
        rest = rest[~inside]
        if len(rest):
            middle = int(rest[0])
            near = np.sqrt(((x[rest] - x[middle]) ** 2).sum(1))
    node.children = [cover_tree(x, own, c) for c, own in groups]
    small = np.concatenate([own for _, own in single]) if single else points[:0]
    for low in range(0, len(small), LEAF):
        own = small[low : low + LEAF]
        mean = x[own].mean(0)
        leaf = Node(mean, own, float(np.sqrt(((x[own] - mean) ** 2).sum(1)).max()), top(own))
        node.children.append(leaf)
    return node


class Search:
    """Best k of a block of data for each query of a block of queries, of scores that reach the query's ``worst``."""

    def __init__(self, q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, worst: np.ndarray, q_row: np.ndarray, x_row: np.ndarray):
        self.q, self.q_id, self.x, self.x_id, self.k, self.q_row, self.x_row = q, q_id, x, x_id, k, q_row, x_row
        self.best: list[list[tuple[int, int]]] = [[] for _ in q_id]  # (-score, vec_id), ascending
        self.worst = worst.copy()
        self.compared = 0
        biggest = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
        self.exact = float(biggest) ** 2 * q.shape[1] < 2**53

    def bound(self, a: Node, b: Node) -> float:
        return float(largest_product(float(a.centre @ b.centre), a.norm, a.radius, a.top, b.norm, b.radius, b.top))

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        self.compared += len(a) * len(b)
        if self.exact:
            score = self.q[a] @ self.x[b].T
        else:
            score = self.q[a].astype(np.int64) @ self.x[b].astype(np.int64).T
        use = (score >= self.worst[a, None]) & (self.q_row[a, None] != self.x_row[b])
        for i in np.flatnonzero(use.any(1)):
            own = np.flatnonzero(use[i])
            merged = self.best[a[i]] + list(zip((-score[i, own]).astype(np.int64).tolist(), self.x_id[b[own]].tolist(), strict=True))
            merged.sort()
            del merged[self.k :]
            self.best[a[i]] = merged
            if len(merged) == self.k:
                self.worst[a[i]] = max(self.worst[a[i]], -merged[-1][0])

    def walk(self, a: Node, b: Node) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self.bound(a, b) < self.worst[a.points].min():
                continue
            if not a.children and not b.children:
                self.compare(a.points, b.points)
            elif b.children and (not a.children or b.radius >= a.radius):
                # the most promising is looked at first
                stack += [(a, c) for c in sorted(b.children, key=lambda c: self.bound(a, c))]
            else:
                stack += [(c, b) for c in a.children]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def pivots_of(data: DataFrame, wanted: int) -> dict[int, np.ndarray]:
    """For each length of vectors in a sample, at most ``wanted`` pivots, each the vector farthest from those before."""
    rows = data.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE).select("vector").collect()
    found = {}
    for dim in sorted({len(r[0]) for r in rows}):
        x = np.array([r[0] for r in rows if len(r[0]) == dim], float).reshape(-1, dim)
        chosen, distance = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < wanted and distance.max() > 0:
            chosen.append(int(distance.argmax()))
            distance = np.minimum(distance, ((x - x[chosen[-1]]) ** 2).sum(1))
        found[dim] = x[chosen]
    return found


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim, cell, distance (to the cell's pivot) and norm; lengths without a pivot share cell -1."""
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))
    names = [*rows.columns, "dim", "cell", "distance", "norm"]
    where = rows.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = pa.compute.list_value_length(batch.column(where)).to_numpy(zero_copy_only=False).astype(np.int64)
            cell, distance, norm = np.full(len(dim), -1), np.zeros(len(dim)), np.zeros(len(dim))
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                x = _matrix(batch.column(where).take(pa.array(own)), len(own))
                norm[own] = np.sqrt((x**2).sum(1))
                if d in pivots:
                    p = pivots[d]
                    near = ((p**2).sum(1) - 2 * (x @ p.T)).argmin(1)
                    cell[own], distance[own] = near + first[d], np.sqrt(((x - p[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(cell), pa.array(distance), pa.array(norm)], names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", dim long, cell long, distance double, norm double")


_TASK = ("cell", "block", "dim", "part")


def meet(data: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """q, query_id, vec_id, score of the best k of each block that a query visits, and rows without q that hold the number
    of pairs compared. ``data``: cell, block, dim, part, vec_id, row, vector; ``visits``: the same, q and worst.

    A partition's rows come sorted, a block's data before its queries; one block and one group of queries are held."""
    blank = {"q": F.lit(None).cast("long"), "worst": F.lit(None).cast("double")}
    sides = [df.select(*_TASK, F.lit(side).alias("side"), "vec_id", "row", "vector", *(F.col(c) if side else v.alias(c) for c, v in blank.items())) for side, df in enumerate((data, visits))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, x, x_id, x_row = None, None, [], [], []
        asked: list[tuple] = []

        def answer() -> pa.RecordBatch:
            nonlocal tree, x, x_id, x_row
            if tree is None:
                x, x_id, x_row = np.concatenate(x), np.concatenate(x_id), np.concatenate(x_row)
                tree = cover_tree(x, np.arange(len(x)), 0)
            q, q_id, q_row, number, worst = (np.concatenate(part) for part in zip(*asked, strict=True))
            asked.clear()
            s = Search(q, q_id, x, x_id, k, worst, q_row, x_row)
            s.walk(cover_tree(q, np.arange(len(q)), 0), tree)
            rows = [(int(n), int(i), v, -m, 0) for n, i, own in zip(number, q_id, s.best, strict=True) for m, v in own] + [(None, None, None, None, s.compared)]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], ["q", "query_id", "vec_id", "score", "compared"])

        for batch in batches:
            keys = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(5)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if (key := tuple(keys[:4, low].tolist())) != now:
                    if asked:
                        yield answer()
                    now, tree, x, x_id, x_row = key, None, [], [], []
                for at in range(low, high, QUERY_BLOCK):
                    part = batch.slice(at, min(QUERY_BLOCK, high - at))
                    vectors = _matrix(part.column(7), part.num_rows)
                    ids, rows = (part.column(j).to_numpy(zero_copy_only=False) for j in (5, 6))
                    if keys[4, low] == 0:
                        x.append(vectors)
                        x_id.append(ids)
                        x_row.append(rows)
                    elif len(x):
                        asked.append((vectors, ids, rows, part.column(8).to_numpy(zero_copy_only=False), part.column(9).to_numpy(zero_copy_only=False)))
                        if sum(len(a[1]) for a in asked) >= QUERY_BLOCK:
                            yield answer()
        if asked:
            yield answer()

    sent = sides[0].unionByName(sides[1]).repartition(*_TASK).sortWithinPartitions(*_TASK, "side")
    return sent.mapInArrow(run, "q long, query_id long, vec_id long, score long, compared long")


def search(data: DataFrame, queries: DataFrame, k: int = K, data_block: int = DATA_BLOCK, compared: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score from frames of vec_id, row (a number of its own for each row, the same on both sides)
    and vector (array of double, integers); with ``compared`` instead the number of pairs whose inner product was taken."""
    n_queries = queries.count()
    pivots = pivots_of(data, min(PIVOTS, max(16, data.count() // data_block)))
    centres = [p for own in pivots.values() for p in own]
    lengths = np.array([len(p) for p in centres])
    data = in_cells(data, pivots)
    cells = {r["cell"]: r for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("top")).collect()}
    blocks = {c: -(-r["n"] // data_block) for c, r in cells.items()}
    if not n_queries or not cells:
        empty = data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        return empty.agg(F.lit(0).cast("long").alias("compared")) if compared else empty
    copies = -(-n_queries // QUERIES_A_TASK)
    per_cell = F.get(F.array(*(F.lit(blocks.get(c, 0)).cast("long") for c in range(-1, len(centres)))), (F.col("cell") + 1).cast("int"))
    placed = data.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), per_cell)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    # a query's first visit: one block of its own cell, or of the first cell of its length that has rows
    asking = checkpoint(in_cells(queries.withColumn("q", F.monotonically_increasing_id()), pivots)).drop("distance")
    part = F.pmod(F.xxhash64("q"), F.lit(copies)).cast("long").alias("part")
    home = asking.where(F.col("cell").isin(*blocks)).withColumn("block", F.pmod(F.xxhash64("q", F.lit(1)), per_cell))
    first = checkpoint(meet(placed, home.select("cell", "block", "dim", part, "vec_id", "row", "vector", "q", F.lit(float("-inf")).alias("worst")), k))
    seeds = first.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("worst"))
    known = asking.join(home.select("q", F.col("block").alias("seen")), "q", "left").join(seeds, "q", "left").fillna({"worst": float("-inf"), "seen": -1})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells where a better score may be, for each query."""
        own = {d: np.array([c for c in np.flatnonzero(lengths == d).tolist() if c in cells], int) for d in pivots}
        for batch in batches:
            lists = []
            dims, vectors, worst = (batch.column(j) for j in (0, 1, 2))
            for i, d in enumerate(dims.to_pylist()):
                if d not in own:
                    lists.append([-1] if -1 in cells else [])
                    continue
                q = np.array(vectors[i].values.to_numpy(zero_copy_only=False), float)
                p, norm = pivots[d][own[d] - int(np.flatnonzero(lengths == d)[0])], float(np.sqrt(q @ q))
                radius, top = (np.array([cells[c][x] for c in own[d].tolist()]) for x in ("radius", "top"))
                most = largest_product(p @ q, norm, 0.0, norm, np.sqrt((p**2).sum(1)), radius, top)
                lists.append(own[d][most >= worst[i].as_py()].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(1, batch.num_columns)), pa.array(lists, pa.list_(pa.int64()))], ["vector", "worst", "vec_id", "row", "q", "home", "seen", "dim", "cells"])

    going = known.select("dim", "vector", "worst", "vec_id", "row", "q", F.col("cell").alias("home"), "seen", F.col("dim").alias("dim2")).mapInArrow(reach, "vector array<double>, worst double, vec_id long, row long, q long, home long, seen long, dim long, cells array<long>")
    going = going.withColumn("cell", F.explode("cells")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), per_cell - 1)))
    second = meet(placed, going.where((F.col("cell") != F.col("home")) | (F.col("block") != F.col("seen"))).select("cell", "block", "dim", part, "vec_id", "row", "vector", "q", "worst"), k)
    local = first.unionByName(second)
    if compared:
        return local.agg(F.sum("compared").alias("compared"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return local.where("q is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, row and vector of the rows that take part: floor(SCALE * x) of each component."""
    finite: Column = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), whole.alias("vector"))


def op5_topk(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    # read once; a row keeps its number
    data = checkpoint(quantised(embeddings))
    return search(data, data.where(F.col("vec_id") % every == 0), k)


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as w from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select *, row_number() over () as q from v),
s as (select q.q, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) as score from n q, n c
    where q.vec_id % 100 = 0 and c.q <> q.q and len(q.w) = len(c.w)),
r as (select query_id, cast(row_number() over (partition by q order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 10
"""
