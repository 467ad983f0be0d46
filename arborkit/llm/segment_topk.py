"""Exact top-k by integer inner product, pruned with segment statistics.

Components become ``floor(64 * x)``.  A shard's vectors and the queries that meet
it are turned by one orthogonal matrix (the principal axes of the shard's
group), which leaves inner products as they are and gathers variance in few
segments.  A vector is then cut into 1, 4, 16 and 32 equal segments (as its
length allows) with a mean and a deviation each.  For equal segments of two
vectors, ``a.b <= len * (mean_a * mean_b + dev_a * dev_b)`` (Cauchy-Schwarz on
the parts around the means), that is, the squared distance is at least ``len *
((mean_a - mean_b)**2 + (dev_a - dev_b)**2)``.  Coarse to fine, pairs whose bound
cannot reach the query's present k-th score are dropped, and survivors get exact
scores on the integers.  The k-th score starts from a sample of real candidates
and rises; no true result is lost.  A level that drops less than ``WORTH`` of a
shard's first tile is passed over for the rest of it, as its bounds would cost
more than they save.

Ties go to smaller ids.  Rows whose id is null or whose vector is null, empty or
has null or non-finite components take no part (zero vectors do); rows that
repeat an id count once (of several vectors the least).  Vectors meet only
vectors of their dimension.  Scores beyond the range of a long are held at its
ends.  Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import BLOCK_BYTES, SHARD_BYTES, distinct_vectors, packed, raised, top_k

SCALE = 64.0
SEGMENTS = (1, 4, 16, 32)
TILE, JUDGED, WORTH = 512, 1, 0.05
#: Widest vectors that are turned (finding the axes takes the cube of the width).
TURNED = 1024
#: Sums of products below this are exact in double precision.
EXACT = 2**53


def axes(x: np.ndarray) -> np.ndarray:
    """Principal axes of the rows, strongest first (columns)."""
    if x.shape[1] > TURNED:
        return np.eye(x.shape[1])
    size = np.abs(x).max(initial=0.0) or 1.0
    return np.linalg.eigh((x / size).T @ (x / size))[1][:, ::-1]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, scaled so that dot products bound."""
    parts = x.reshape(len(x), segments, -1)
    width = parts.shape[2]
    return np.sqrt(width) * np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1)


def integer_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of paired rows."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([max(low, min(high, sum(int(x) * int(y) for x, y in zip(p, q)))) for p, q in zip(a, b)], dtype=np.int64)


class SegmentSearch:
    """Search of one shard; ``pairs`` counts those looked at, ``left`` those after each level."""

    def __init__(self, v: np.ndarray, k: int):
        self.v, self.k = v, k
        self.turn = axes(v)
        self.levels = [s for s in SEGMENTS if v.shape[1] % s == 0]
        turned = v @ self.turn
        self.stats = [statistics(turned, s) for s in self.levels]
        self.top = float(np.abs(v).max(initial=0.0))
        self.pairs, self.left = 0, [0] * len(self.levels)

    def run(self, q: np.ndarray, floor: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turned = q @ self.turn
        stats = [statistics(turned, s) for s in self.levels]
        reach = float(np.abs(q).max(initial=0.0)) * self.top * q.shape[1]
        # bounds and floors are off by rounding only: keep that much more
        slack = 1e-6 + 1e-9 * reach
        floor = np.minimum(floor, 2.0**63)  # scores are held there
        use = list(range(len(self.levels)))
        found: list[tuple] = []
        for start in range(0, len(self.v), TILE):
            tile = self.v[start : start + TILE]
            alive = own[:, None] != np.arange(start, start + len(tile))[None, :]
            self.pairs += alive.size
            i, j = np.nonzero(alive)
            for level in list(use):
                a, b = stats[level], self.stats[level]
                if len(i) > 0.2 * alive.size:  # dense: one product for all
                    bound = (a @ b[start : start + TILE].T)[i, j]
                else:
                    bound = np.einsum("ij,ij->i", a[i], b[start + j])
                kept = bound >= floor[i] - slack
                if start == JUDGED * TILE and kept.sum() > (1 - WORTH) * len(i):  # by then floors have risen
                    use.remove(level)
                i, j = i[kept], j[kept]
                self.left[level] += len(i)
            for level in set(range(len(self.levels))) - set(use):
                self.left[level] += alive.size if start > JUDGED * TILE else 0
            exact = (q @ tile.T)[i, j].astype(np.int64) if reach < EXACT and len(i) > 0.05 * alive.size else integer_dot(q[i], tile[j])
            kept = exact >= floor[i] - slack
            i, j, exact = i[kept], j[kept], exact[kept]
            found.append((i, start + j, exact))
            floor = raised(floor, i, exact, self.k)
        return tuple(np.concatenate(c) for c in zip(*found))


def exact_top_k(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` highest scores."""
    rows = distinct_vectors(table, zero=True)
    rows = materialize(rows.select("vec_id", F.transform("v", _floored).alias("v")), "integer-vectors")
    index, shards = packed(rows, SHARD_BYTES)
    index = materialize(index.withColumn("extra", F.lit(None).cast("binary")), "integer-shards")
    asked = materialize(packed(rows.where(F.col("vec_id") % every == 0), BLOCK_BYTES)[0], "query-blocks")
    discard(rows)
    return top_k(asked, index, shards, k, lambda v, extra: SegmentSearch(v, k), SegmentSearch.run, "long")


def _floored(x):
    y = F.floor(x * SCALE).cast("double")
    return F.when(F.abs(x) < 1e14, y).otherwise(x * SCALE)
