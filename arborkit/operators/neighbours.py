"""Nearest points through k-d trees: in one task, and as a join of clouds of any size.

A tree halves its points at the median of the widest axis; nodes keep the box of
their points.  A batch of queries first goes down to one leaf each, whose distances
bound the search, then down the whole tree once, every node with the queries whose
bound reaches its box.  Distances are computed leaf by leaf, never as a table of all
queries and points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a leaf; clouds that are one leaf need no tree.
LEAF = 64
#: Distances that one step holds.
CHUNK = 2_000_000
#: Queries that meet a small target at once, so that their distances stay in a core's cache.
LOT = 4096
#: Twice the error that a distance's order may have in single precision, as a multiple of the terms added up (some 7 epsilon); and what moving the places to a middle adds.
SINGLE, MOVED = 16 * float(np.finfo(np.float32).eps), 1e-15
#: Points of one tree and queries of one group in :func:`nearest_points`.
TREE_POINTS, GROUP_QUERIES = 2_000_000, 500_000


def squares(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Squared distances, axis by axis."""
    out = np.zeros((len(query), len(target)))
    for axis in range(query.shape[1]):
        d = query[:, axis, None] - target[None, :, axis]
        d *= d
        out += d
    return out


def squares_at(query: np.ndarray, target: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distance of each query from the target point of its own: what :func:`squares` has there."""
    out = np.zeros(len(query))
    for axis in range(query.shape[1]):
        d = query[:, axis] - np.ascontiguousarray(target[:, axis]).take(at)
        d *= d
        out += d
    return out


def least_of(table: np.ndarray, slack: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the least values along an axis of at most 255 stand, and where that is open: more than one value (or none) within ``slack`` of the least."""
    near = (table <= np.expand_dims(table.min(axis=axis) + slack, axis)).view(np.uint8)
    open_ = near.sum(axis=axis, dtype=np.uint8) != 1
    n = table.shape[axis]
    near *= np.arange(n, 0, -1, dtype=np.uint8).reshape([-1 if x == axis else 1 for x in range(table.ndim)])
    return n - near.max(axis=axis).astype(np.int64), open_


def nearest_of_few(query: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query's nearest of at most 255 points and its squared distance; ties to earlier points.

    A matrix product in single precision orders a query's distances.  Where its error
    leaves the nearest open, and for the distance itself, :func:`squares` decides.
    """
    at, d2 = np.zeros(len(query), dtype=np.int64), np.zeros(len(query))
    middle = target.mean(axis=0)
    own = target - middle
    square = (own**2).sum(axis=1)
    reach = np.sqrt(square.max())
    moved = MOVED * reach * np.abs(middle).max()
    with np.errstate(over="ignore", invalid="ignore"):
        one = np.concatenate([-2 * own, square[:, None]], axis=1).astype(np.float32)
        for lo in range(0, len(query), LOT):
            q = query[lo : lo + LOT]
            other = np.ones((q.shape[1] + 1, len(q)), dtype=np.float32)
            for axis in range(q.shape[1]):
                np.subtract(q[:, axis], middle[axis], out=other[axis], casting="same_kind")
            slack = (SINGLE * reach * (reach + 2 * np.sqrt((other[:-1] ** 2).sum(axis=0))) + moved).astype(np.float32)
            best, open_ = least_of(one @ other, slack, 0)
            open_ = np.flatnonzero(open_)
            if len(open_):
                best[open_] = squares(target, q[open_]).argmin(axis=0)
            at[lo : lo + LOT], d2[lo : lo + LOT] = best, squares_at(q, target, best)
    return at, d2


class KdTree:
    """Index of a point set; equal distances go to the earlier point."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        points = np.asarray(points, dtype=float)
        order = np.arange(len(points))
        start, end, child, box = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            number = len(start)
            start.append(a), end.append(b), child.append([]), box.append((low, high))
            if parent >= 0:
                child[parent].append(number)
            if b - a > leaf:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, (high - low).argmax()], half)]
                todo += [(a, a + half, number), (a + half, b, number)]
            else:
                order[a:b].sort()
        self.order, self.points = order, points[order]
        self.start, self.end, self.child = start, end, child
        self.low, self.high = (np.stack(x) for x in zip(*box))
        self.measured = 0

    def _gap(self, q: np.ndarray, node: int) -> np.ndarray:
        """Squared distance from queries to a node's box."""
        out = np.zeros(len(q))
        for axis in range(q.shape[1]):
            d = np.maximum(np.maximum(self.low[node, axis] - q[:, axis], q[:, axis] - self.high[node, axis]), 0.0)
            d *= d
            out += d
        return out

    def query(self, q: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Places of each query's ``k`` nearest points and their squared distances, nearest first."""
        k = min(k, len(self.order))
        far, at = np.full((len(q), k), np.inf), np.full((len(q), k), len(self.order))
        bound = np.full(len(q), np.inf)
        self._descend(q, k, bound)
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, who = stack.pop()
            who = who[self._gap(q[who], node) <= bound[who]]
            if not len(who):
                continue
            if self.child[node]:
                stack += [(c, who) for c in self.child[node]]
                continue
            a, b = self.start[node], self.end[node]
            for lot in np.array_split(who, -(-len(who) * (b - a) // CHUNK)):
                d = squares(q[lot], self.points[a:b])
                self.measured += d.size
                if k == 1:
                    best = d.argmin(axis=1)
                    d, found = d[np.arange(len(lot)), best], self.order[a:b][best]
                    better = (d < far[lot, 0]) | ((d == far[lot, 0]) & (found < at[lot, 0]))
                    far[lot[better], 0], at[lot[better], 0] = d[better], found[better]
                else:
                    d, found = np.concatenate([far[lot], d], axis=1), np.concatenate([at[lot], np.broadcast_to(self.order[a:b], d.shape)], axis=1)
                    best = np.lexsort((found, d), axis=1)[:, :k]
                    far[lot], at[lot] = np.take_along_axis(d, best, axis=1), np.take_along_axis(found, best, axis=1)
                bound[lot] = np.minimum(bound[lot], far[lot, k - 1])
        return at, far

    def _descend(self, q: np.ndarray, k: int, bound: np.ndarray) -> None:
        """Bound each query's search by the ``k``-th distance within the leaf whose box is nearest on its way."""
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, who = stack.pop()
            a, b = self.start[node], self.end[node]
            if self.child[node]:
                one, two = self.child[node]
                to_one = self._gap(q[who], one) <= self._gap(q[who], two)
                stack += [(c, w) for c, w in ((one, who[to_one]), (two, who[~to_one])) if len(w)]
            elif b - a >= k:
                for lot in np.array_split(who, -(-len(who) * (b - a) // CHUNK) or 1):
                    bound[lot] = np.partition(squares(q[lot], self.points[a:b]), k - 1, axis=1)[:, k - 1]


def nearest(query: np.ndarray, target: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``target`` of each query's ``k`` nearest points and their distances; ties to earlier points."""
    k = min(k, len(target))
    if not len(query) or not k:
        return np.zeros((len(query), k), dtype=np.int64), np.zeros((len(query), k))
    if len(target) > max(LEAF, 2 * k):
        at, far = KdTree(target, max(LEAF, 2 * k)).query(query, k)
        return at, np.sqrt(far)
    if k == 1:
        at, far = nearest_of_few(query, target)
        return at[:, None], np.sqrt(far)[:, None]
    at, far = np.zeros((len(query), k), dtype=np.int64), np.zeros((len(query), k))
    step = max(1, CHUNK // len(target))
    for lo in range(0, len(query), step):
        d = squares(query[lo : lo + step], target)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        at[lo : lo + step], far[lo : lo + step] = best, np.take_along_axis(d, best, axis=1)
    return at, np.sqrt(far)


def least_distances(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Distance of each query from its nearest point in ``target``."""
    return nearest(query, target)[1][:, 0]


# -------------------------------------------------------------------------- the join
def nearest_points(queries: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each point of a query cloud its nearest point in the paired target cloud.

    ``pairs(query_id, target_id)`` says which clouds meet; ties go to the smaller
    ``dot_id``.  A target's points become a tree in the task that its queries stream
    through.  Targets above ``TREE_POINTS`` are split into several trees, whose
    answers are merged by the least distance; a target's queries above
    ``GROUP_QUERIES`` are dealt to several copies of its trees.  Points without all
    coordinates take no part.
    """
    placed = "x is not null and y is not null and z is not null"
    q = queries.where(placed).select(F.col("neuron_id").alias("query_id"), F.col("dot_id").alias("q_dot"), *"xyz")
    t = targets.where(placed).select(F.col("neuron_id").alias("target_id"), F.col("dot_id").alias("t_dot"), *"xyz")
    kinds = {c: df.schema[c].dataType.simpleString() for df in (q, t) for c in df.columns}
    pairs = pairs.select("query_id", "target_id").distinct()
    asked = pairs.join(q.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").groupBy("target_id").agg(F.sum("n").alias("n"))
    sizes = asked.withColumn("groups", F.ceil(F.col("n") / GROUP_QUERIES)).drop("n")
    sizes = sizes.join(t.groupBy("target_id").agg(F.ceil(F.count("*") / TREE_POINTS).alias("trees")), "target_id")
    many = (sizes.agg(F.max("trees")).first()[0] or 0) > 1
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    points = t.join(sizes, "target_id").withColumn("tree", F.pmod(F.xxhash64("t_dot"), F.col("trees"))).withColumn("grp", spread("groups"))
    points = points.select("target_id", "tree", "grp", "t_dot", null("query_id"), null("q_dot"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    asking = pairs.join(q, "query_id").join(sizes, "target_id").withColumn("grp", F.pmod(F.xxhash64("query_id", "q_dot"), F.col("groups"))).withColumn("tree", spread("trees"))
    asking = asking.select("target_id", "tree", "grp", null("t_dot"), "query_id", "q_dot", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    # points (no query) come before queries
    met = points.unionByName(asking).repartition("target_id", "tree", "grp").sortWithinPartitions("target_id", "tree", "grp", F.col("query_id").asc_nulls_first(), "t_dot")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, dots, parts, tree = None, [], [], None
        for batch in batches:
            keys = [batch.column(c) for c in range(3)]
            asks = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            xyz = np.stack([batch.column(c).to_numpy() for c in (6, 7, 8)], axis=1)
            codes = np.stack([c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in keys])
            cuts = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0) | (asks[1:] != asks[:-1]), True])
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(c[int(lo)].as_py() for c in keys)
                if key != at:
                    at, dots, parts, tree = key, [], [], None
                if not asks[lo]:
                    parts.append(xyz[lo:hi])
                    dots.append(batch.column(3).slice(lo, hi - lo))
                    continue
                if tree is None:
                    tree, dots = KdTree(np.concatenate(parts)), [pa.concat_arrays(dots)]
                    parts = []
                found, d2 = tree.query(xyz[lo:hi])
                yield pa.record_batch([batch.column(4).slice(lo, hi - lo), keys[0].slice(lo, hi - lo), batch.column(5).slice(lo, hi - lo), dots[0].take(pa.array(found[:, 0])), pa.array(d2[:, 0])], names=["query_id", "target_id", "q_dot", "t_dot", "d2"])

    out = met.mapInArrow(run, f"query_id {kinds['query_id']}, target_id {kinds['target_id']}, q_dot {kinds['q_dot']}, t_dot {kinds['t_dot']}, d2 double")
    if many:
        out = out.groupBy("query_id", "target_id", "q_dot").agg(F.min(F.struct("d2", "t_dot")).alias("m")).select("query_id", "target_id", "q_dot", "m.*")
    return out.select("query_id", "target_id", "q_dot", "t_dot", F.sqrt("d2").alias("distance"))
