"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

Vectors gain one component that brings all to the largest norm, and queries a
zero there, so that the nearest vector in Euclidean distance is the one with the
largest inner product.  Each shard (``vectors.SHARD_BYTES`` of vectors) holds a
tree whose nodes keep a vantage point and the distance ranges of their two
halves, and every row keeps its distances to the vantage points above it.  A
half, or a row of a leaf, is passed over where the triangle inequality puts it
further away than ``factor`` times the query's present search radius; factor one
restores exact search, smaller factors prune more.  All queries of a block go
down a tree together, and every node is met once: the search radius starts from a
sample of the table, so little is gained by visiting nearer halves first.

Scores are exact inner products in double precision on the vectors as given;
ties go to smaller ids.  Rows whose id is null or whose vector is null, empty,
zero or has null or non-finite components take no part; rows that repeat an id
count once (of several vectors the least).  Vectors meet only vectors of their
dimension.  Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import BLOCK_BYTES, PACKED, SHARD_BYTES, distinct_vectors, dot, packed, top_k, unpack

LEAF = 64
#: Search radius factor; measured recall at 20 and share of rows measured are in the README.
FACTOR = 0.22


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, nodes ``(start, end, middle)``, ``(lo, hi)`` ranges, distances.

    A node's first row is its vantage point, rows up to ``middle`` are its nearer
    half.  Leaves have middle -1.  Children are found by ``start`` and ``end``.
    Distances of a row, one column a level, are those to the vantage points above it.
    """
    order = np.arange(len(x))
    nodes, ranges, paths = [], [], []
    stack = [(0, len(x), 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a <= LEAF:
            nodes.append((a, b, -1))
            ranges.append((0.0, 0.0, 0.0, 0.0))
            continue
        own = order[a:b]
        # the row furthest from the node's first stands at a corner
        far = int(((x[own] - x[own[0]]) ** 2).sum(axis=1).argmax())
        own[[0, far]] = own[[far, 0]]
        d = np.sqrt(((x[own[1:]] - x[own[0]]) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")
        order[a + 1 : b] = own[1:][near]
        d = d[near]
        if depth == len(paths):
            paths.append(np.zeros(len(x)))
        paths[depth][order[a + 1 : b]] = d
        half = len(d) // 2
        nodes.append((a, b, a + 1 + half))
        ranges.append((d[0], d[half - 1], d[half], d[-1]))
        stack += [(a + 1, a + 1 + half, depth + 1), (a + 1 + half, b, depth + 1)]
    path = np.stack(paths, axis=1)[order] if paths else np.zeros((len(x), 0))
    return order, np.array(nodes, dtype=np.int64), np.array(ranges), path


class TreeSearch:
    """Search of one tree; ``measured`` counts the pairs that got a distance.

    Rows' distances to the vantage points above them are held in 256 steps a level,
    and a query's reach is widened to whole steps, so nothing in reach is missed.
    """

    def __init__(self, x: np.ndarray, nodes: np.ndarray, ranges: np.ndarray, path: np.ndarray, k: int, factor: float):
        self.x, self.k, self.factor = x, k, factor
        self.at = {(int(a), int(b)): (int(m), r) for (a, b, m), r in zip(nodes, ranges)}
        self.norms = (x**2).sum(axis=1)
        self.low = path.min(axis=0, initial=np.inf)
        span = path.max(axis=0, initial=-np.inf) - self.low
        self.step = np.where(span > 0, span / 255, 1.0)
        self.path = np.ascontiguousarray(((path - self.low) / self.step).clip(0, 255).astype(np.uint8).T)
        self.measured = 0

    def run(self, q: np.ndarray, own: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that may be among the ``k`` nearest; ``own``: a row to leave out."""
        self.q, self.own, self.radius = q, own, radius.copy()
        self.best = np.repeat(radius[:, None], self.k, axis=1)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.qnorms = (q**2).sum(axis=1)
        # what rounding may add to a distance, near zero as well
        self.slack = 1e-6 * np.sqrt(self.qnorms + self.norms.max(initial=0.0))
        self.above = np.zeros((len(q), len(self.path)))
        self._visit(0, len(self.x), np.arange(len(q)), 0)
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*self.pairs))

    def _squares(self, who: np.ndarray, a: int, b: int) -> np.ndarray:
        d = self.q[who] @ self.x[a:b].T
        d *= -2
        d += self.qnorms[who, None]
        d += self.norms[None, a:b]
        return d

    def _meet(self, who: np.ndarray, a: int, squares: np.ndarray, alive: np.ndarray | None) -> None:
        """Take the rows from ``a`` on within the radius into account."""
        near = squares <= ((self.radius[who] + self.slack[who]) ** 2)[:, None]
        if alive is not None:
            near &= alive
        mine = self.own[who] - a
        inside = np.flatnonzero((mine >= 0) & (mine < squares.shape[1]))
        near[inside, mine[inside]] = False
        i, j = np.nonzero(near)
        if not len(i):
            return
        self.pairs.append((who[i], a + j))
        rows = np.unique(i)
        found = np.where(near[rows], np.sqrt(np.maximum(squares[rows], 0)), np.inf)
        merged = np.concatenate([self.best[who[rows]], found], axis=1)
        self.best[who[rows]] = np.partition(merged, self.k - 1, axis=1)[:, : self.k]
        self.radius[who[rows]] = self.best[who[rows]].max(axis=1)

    def _leaf(self, a: int, b: int, who: np.ndarray, depth: int) -> None:
        """Rows that no vantage point above puts too far away get a distance."""
        reach = self.factor * self.radius[who] + self.slack[who]
        alive = np.ones((len(who), b - a), dtype=bool)
        for level in range(depth):
            centre = (self.above[who, level] - self.low[level]) / self.step[level]
            width = np.minimum(reach / self.step[level], 1e300)
            first, last = np.floor(centre - width), np.floor(centre + width)
            none = (first > 255) | (last < 0)
            first, last = first.clip(0, 255).astype(np.uint8), last.clip(0, 255).astype(np.uint8)
            # within first..last, as one comparison of unsigned differences
            alive &= (self.path[level, None, a:b] - first[:, None]) <= (last - first)[:, None]
            alive[none] = False
        some = np.flatnonzero(alive.any(axis=1))
        self.measured += int(np.count_nonzero(alive))
        if len(some):
            self._meet(who[some], a, self._squares(who[some], a, b), alive[some])

    def _visit(self, a: int, b: int, who: np.ndarray, depth: int) -> None:
        if not len(who) or a >= b:
            return
        middle, (lo1, hi1, lo2, hi2) = self.at[a, b]
        if middle < 0:
            return self._leaf(a, b, who, depth)
        squares = self._squares(who, a, a + 1)
        self.measured += len(who)
        d = self.above[who, depth] = np.sqrt(np.maximum(squares[:, 0], 0))
        self._meet(who, a, squares, None)
        for start, end, lo, hi in ((a + 1, middle, lo1, hi1), (middle, b, lo2, hi2)):
            gap = np.maximum(np.maximum(d - hi, lo - d), 0)
            self._visit(start, end, who[gap <= self.factor * self.radius[who] + self.slack[who]], depth + 1)


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that brings their square norm to ``norm``."""
    return np.concatenate([v, np.sqrt(np.maximum(norm - (v**2).sum(axis=1), 0))[:, None]], axis=1)


def saved(nodes: np.ndarray, ranges: np.ndarray, path: np.ndarray) -> bytes:
    flat = [np.array([len(nodes), path.shape[1]], dtype=np.float64), nodes.ravel().astype(np.float64), ranges.ravel(), path.ravel()]
    return np.concatenate(flat).tobytes()


def loaded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, dtype=np.float64)
    n, depth = int(flat[0]), int(flat[1])
    nodes, ranges, path = np.split(flat[2:], [3 * n, 7 * n])
    return nodes.reshape(n, 3).astype(np.int64), ranges.reshape(n, 4), path.reshape(-1, depth) if depth else np.zeros((0, 0))


def build_index(rows: DataFrame) -> tuple[DataFrame, int, float]:
    """Packed shards of usable rows with trees (``extra``), their number, and the largest square norm."""
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = unpack(row)
                order, nodes, ranges, path = build(lifted(v, norm))
                columns = ([row["shard"]], [ids[order].tobytes()], [row["dim"]], [v[order].tobytes()], [saved(nodes, ranges, path)])
                types = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "ids", "dim", "vectors", "extra"])

    shards, count = packed(rows, SHARD_BYTES)
    return materialize(shards.mapInArrow(run, PACKED + ", extra binary"), "vp-trees"), count, norm


def nearest(table: DataFrame, k: int = 20, every: int = 20, factor: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found."""
    factor = FACTOR if factor is None else factor
    rows = materialize(distinct_vectors(table, zero=False), "vectors")
    index, shards, norm = build_index(rows)
    asked, _ = packed(rows.where(F.col("vec_id") % every == 0), BLOCK_BYTES)
    asked = materialize(asked, "query-blocks")
    discard(rows)

    def open_shard(v, extra):
        return v, TreeSearch(lifted(v, norm), *loaded(extra), k, factor)

    def search(shard, q, floor, own):
        v, tree = shard
        radius = np.sqrt(np.maximum((q**2).sum(axis=1) + norm - 2 * floor, 0))
        at, to = tree.run(np.concatenate([q, np.zeros((len(q), 1))], axis=1), own, radius)
        # the radius has shrunk since; ties at its edge stay
        return at, to, dot(q[at], v[to])

    return top_k(asked, index, shards, k, open_shard, search, "double")
