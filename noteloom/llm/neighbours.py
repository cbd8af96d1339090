"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected onto M random normal directions; for a pair at distance d the squared projected distance over d^2 is
chi-square distributed with M degrees of freedom. A kd-tree over the projections gives projected neighbours in growing
distance; each is verified on the original vectors, until a nearer vector than the k-th found would have shown up with probability
STOP already. So every true neighbour is found with that probability at least, and what the test leaves out is never compared.

The upper levels of the tree are fitted on a bounded sample and deal the vectors into cells of about PART, each with a tree of its own and a
box around its projections. A query is first answered in its own cell; its k-th distance there then says, by the same test on the
boxes, which other cells it has to visit. A task holds one cell and one block of its queries; a cell is sent as often as it has blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

M = 16
STOP = 0.97
LEAF = 48
PART = 20_000
BLOCK = 2_000
#: Vectors (or as many as hold SAMPLE_BYTES) that the upper levels are fitted on, and cells at most (their boxes, 16 MB, go to every task that routes).
SAMPLE, SAMPLE_BYTES, CELLS = 20_000, 64 << 20, 1 << 16
_STEP = 8  # leaves opened at a time


def chi_square(x: np.ndarray | float, degrees: int = M):
    """The chi-square distribution function for an even number of degrees."""
    half = np.asarray(x, float) / 2
    return 1 - np.exp(-half) * sum(half ** i / math.factorial(i) for i in range(degrees // 2))


def chi_square_inverse(share: float, degrees: int = M) -> float:
    """Where the distribution function reaches a share, by halving."""
    low, high = 0.0, 1e4
    while high - low > 1e-9 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < share else (low, mid)
    return high


def directions(dim: int, m: int = M, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, m))


class Tree:
    """A kd-tree's leaves: places of the points in each, and the boxes around them."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                leaves.append(at)
                continue
            own = points[at]
            order = np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], len(at) // 2)
            todo += [at[order[: len(at) // 2]], at[order[len(at) // 2:]]]
        self.leaves = leaves
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def bounds(self, at: np.ndarray) -> np.ndarray:
        """Least squared distance from at to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        return (gap * gap).sum(axis=1)


class Cells:
    """The upper levels of a kd-tree over projections: for each dimension of vectors a complete binary tree of splits (axis, value)."""

    def __init__(self, samples: dict[int, np.ndarray], depth: int):
        self.depth, self.splits = depth, {}
        for dim, vectors in samples.items():
            axes, values = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
            todo = [(0, vectors @ directions(dim))] if depth else []
            while todo:
                node, own = todo.pop()
                if len(own):
                    axes[node] = np.argmax(np.ptp(own, axis=0))
                    values[node] = np.median(own[:, axes[node]])
                right = own[:, axes[node]] > values[node]
                if 2 * node + 1 < len(axes):
                    todo += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]
            self.splits[dim] = axes, values

    def of(self, dim: int, points: np.ndarray) -> np.ndarray:
        """The cell of each projection."""
        node = np.zeros(len(points), np.int64)
        if dim not in self.splits:
            return node
        axes, values = self.splits[dim]
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > values[node])
        return node - ((1 << self.depth) - 1)


class Part:
    """An index part: its different vectors with their ids (of equal vectors the keep smallest). verified counts comparisons."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int):
        raw = np.ascontiguousarray(vectors + 0.0)
        _, first, inverse = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        self.vectors = raw[first]
        order = np.lexsort((ids, inverse))
        cut = np.searchsorted(inverse[order], np.arange(len(first) + 1))
        self.ids = [np.unique(ids[order[a:b]])[:keep] for a, b in zip(cut, cut[1:])]
        self.map = directions(raw.shape[1])
        self.points = self.vectors @ self.map
        self.tree = Tree(self.points)
        self.verified = 0

    def nearest(self, own: int, query: np.ndarray, k: int, stop: float = STOP, worst: float = np.inf) -> list[tuple[float, int]]:
        """The k nearest found as (distance, id), ties to the smaller id, without the query's own id; none is farther than worst, the
        k-th distance that is known from elsewhere."""
        at = query @ self.map
        bounds = self.tree.bounds(at)
        order = np.argsort(bounds, kind="stable")
        reach = chi_square_inverse(stop)  # projected squares up to reach * worst^2 have to be verified
        waiting, gaps = np.zeros(0, np.int64), np.zeros(0)
        found, dist = np.zeros(0, np.int64), np.zeros(0)
        i, limit = 0, worst
        while i < len(order) or len(waiting):
            frontier = bounds[order[i]] if i < len(order) else np.inf
            ready = gaps <= min(frontier, reach * limit * limit)
            if not ready.any():
                if i >= len(order) or frontier > reach * limit * limit:
                    break
                new = np.concatenate([self.tree.leaves[j] for j in order[i:i + _STEP]])
                gap = self.points[new] - at
                waiting, gaps = np.r_[waiting, new], np.r_[gaps, (gap * gap).sum(axis=1)]
                i += _STEP
                continue
            next_, waiting, gaps = waiting[ready], waiting[~ready], gaps[~ready]
            gap = self.vectors[next_] - query
            d = np.sqrt((gap * gap).sum(axis=1))
            self.verified += len(next_)
            found, dist = np.r_[found, next_], np.r_[dist, d]
            keep = np.argsort(dist, kind="stable")
            if len(keep) > k + 1:  # one of them may be the query's own vector
                keep = keep[dist[keep] <= dist[keep[k]]]
            found, dist = found[keep], dist[keep]
            if len(dist) > k:
                limit = min(limit, dist[k])
        best = sorted((float(d), int(v)) for d, u in zip(dist, found) if d <= worst for v in self.ids[u] if v != own)
        return best[:k]


def _by_dim(table: pa.Table, ids: str, values: str):
    col = table.column(values).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    sizes = np.diff(col.offsets.to_numpy())
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), float)
    at = np.r_[0, np.cumsum(sizes)]
    numbers = table.column(ids).to_numpy()
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), numbers[rows], np.stack([flat[at[r]:at[r] + dim] for r in rows])


def _search(k: int, stop: float):
    names = ["query_id", "vec_id", "score", "verified"]

    def run(index, queries):
        out = []
        if index.num_rows and queries.num_rows:
            asked = {dim: (ids, vecs, worst) for (dim, ids, vecs), worst in _with(queries, "q_id", "q", "worst")}
            for dim, ids, vecs in _by_dim(index, "vec_id", "v"):
                if dim in asked:
                    part = Part(ids, vecs, k + 1)
                    for q, x, w in zip(*asked[dim]):
                        before = part.verified
                        near = part.nearest(int(q), x, k, stop, w)
                        out += [(int(q), v, d, None) for d, v in near] + [(int(q), None, None, part.verified - before)]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names)

    return run


def _with(table: pa.Table, ids: str, values: str, extra: str):
    """_by_dim() with the rows' values of one more column."""
    sizes = np.array([len(x) for x in table.column(values).to_pylist()])
    more = table.column(extra).to_numpy()
    for dim, numbers, vectors in _by_dim(table, ids, values):
        yield (dim, numbers, vectors), more[sizes == dim]


def _dealt(cells: Cells, ids: str, values: str):
    """(cell, dim) added to rows of ids and values."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            sizes = np.array([len(x) for x in table.column(values).to_pylist()])
            cell = np.zeros(len(sizes), np.int64)
            for dim, _, vectors in _by_dim(table, ids, values):
                cell[sizes == dim] = cells.of(dim, vectors @ directions(dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(sizes)], [ids, values, "cell", "dim"])

    return run


def _boxes(batches):
    """Of each batch the box around the projections of each cell: (cell, dim, low, high)."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            where, out = table.column("cell").to_numpy(), []
            sizes = table.column("dim").to_numpy()
            for dim, _, vectors in _by_dim(table, "vec_id", "v"):
                points, own = vectors @ directions(dim), where[sizes == dim]
                for c in np.unique(own):
                    out.append((c, dim, points[own == c].min(axis=0).tolist(), points[own == c].max(axis=0).tolist()))
            cols = list(zip(*out))
            many = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), many, many))], ["cell", "dim", "low", "high"])


def _route(boxes: dict, stop: float):
    """Queries (q_id, q, cell, dim, worst), once for each other cell that may hold something nearer than worst."""
    reach = chi_square_inverse(stop)

    def run(batches):
        for batch in batches:
            rows = []
            for q_id, q, cell, dim, worst in zip(*(c.to_pylist() for c in batch.columns)):
                if dim in boxes:
                    names, low, high = boxes[dim]
                    at = np.array(q, float) @ directions(dim)
                    gap = np.maximum(np.maximum(low - at, at - high), 0)
                    some = names[((gap * gap).sum(axis=1) <= reach * worst * worst) & (names != cell)]
                    rows += [(q_id, q, int(c), dim, worst) for c in some]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, batch.columns)], batch.schema.names)

    return run


def _answers(index: DataFrame, asked: DataFrame, k: int, stop: float, block: int) -> DataFrame:
    """(query_id, vec_id, score, verified) of queries (q_id, q, cell, dim, worst) in their cells, in blocks."""
    blocks = asked.groupBy("cell", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    index = index.join(blocks, ["cell", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.join(blocks, ["cell", "dim"]).withColumn("block", F.pmod(F.xxhash64("q_id"), F.col("blocks")).cast("int")).drop("blocks")
    return index.groupBy("cell", "dim", "block").cogroup(asked.groupBy("cell", "dim", "block")).applyInArrow(
        _search(k, stop), "query_id bigint, vec_id bigint, score double, verified bigint")


def usable(values) -> F.Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return values.isNotNull() & fine & F.exists(values, lambda x: x != 0)


def _found(vectors: DataFrame, queries: DataFrame, k: int, stop: float, part: int, block: int) -> DataFrame:
    """What the cells answer: rows (query_id, vec_id, score), and rows (query_id, verified) with the vectors compared."""
    index = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(usable(F.col("v"))).where("vec_id is not null")
    asked = queries.select(F.col("vec_id").cast("long").alias("q_id"), F.col("embedding").alias("q")).where(usable(F.col("q"))).where("q_id is not null")
    number, width = index.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    depth = max(0, min(math.ceil(math.log2(max(number, 1) / part)), CELLS.bit_length() - 1))
    samples: dict[int, list] = {}
    if depth:
        for r in index.orderBy(F.xxhash64("vec_id")).limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).collect():
            samples.setdefault(len(r.v), []).append(r.v)
    cells = Cells({d: np.array(v, float) for d, v in samples.items()}, depth)
    type_of = lambda df, c: df.schema[c].dataType.simpleString()
    index = index.mapInArrow(_dealt(cells, "vec_id", "v"), f"vec_id bigint, v {type_of(index, 'v')}, cell bigint, dim bigint")
    asked = asked.mapInArrow(_dealt(cells, "q_id", "q"), f"q_id bigint, q {type_of(asked, 'q')}, cell bigint, dim bigint")
    infinite = F.lit(float("inf"))
    if not depth:
        return _answers(index, asked.withColumn("worst", infinite), k, stop, block)
    index, asked = saved(index), saved(asked)
    each = F.array(*[F.struct(F.min(F.col("low")[i]).alias("low"), F.max(F.col("high")[i]).alias("high")) for i in range(M)])
    boxes: dict[int, list] = {}
    for r in index.mapInArrow(_boxes, "cell bigint, dim bigint, low array<double>, high array<double>").groupBy("cell", "dim").agg(each.alias("box")).collect():
        boxes.setdefault(r.dim, []).append((r.cell, [x.low for x in r.box], [x.high for x in r.box]))
    boxes = {d: (np.array([x[0] for x in b]), np.array([x[1] for x in b]), np.array([x[2] for x in b])) for d, b in boxes.items()}
    home = saved(_answers(index, asked.withColumn("worst", infinite), k, stop, block))
    kth = home.where("vec_id is not null").select("query_id", "vec_id", "score").distinct().groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("score")), k)).alias("worst"))
    known = asked.join(kth, asked.q_id == kth.query_id, "left").select("q_id", "q", "cell", "dim", F.coalesce("worst", infinite).alias("worst"))
    away = saved(known.mapInArrow(_route(boxes, stop), known.schema))
    return home.union(_answers(index, away, k, stop, block))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, stop: float = STOP, part: int = PART, block: int = BLOCK) -> DataFrame:
    """The k nearest found of each query by Euclidean distance: (query_id, rank, vec_id, score).

    vectors and queries: vec_id and embedding. Vectors that are null, zero, or hold null or non-finite components, and rows without an id,
    take no part; vectors are compared with those of their own dimension only; a query's own id is no answer; of repeated ids
    the nearest row counts; ties go to the smaller id; an empty table gives no rows; other columns are ignored."""
    near = _found(vectors, queries, k, stop, part, block).where("vec_id is not null")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def effort(vectors: DataFrame, queries: DataFrame, k: int = 10, stop: float = STOP, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, verified): the vectors that each query is compared with."""
    return _found(vectors, queries, k, stop, part, block).where("vec_id is null").groupBy("query_id").agg(F.sum("verified").alias("verified"))


def every_hundredth(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.where("vec_id % 100 = 0"))
