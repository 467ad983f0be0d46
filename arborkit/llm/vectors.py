"""Vector tables in packed shards, and query blocks that are dealt against them.

Shards and query blocks are rows of two tables.  Shards are dealt into groups of
a bounded number; every block goes to every group (a stated query set against
all rows, in blocks), where it meets the group's shards one after another and
leaves each query's best of the group.  Only those are merged.  Nothing goes
through the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the vectors of a shard and of a block of queries; shards of a group; rows of a sample.
SHARD_BYTES, BLOCK_BYTES, GROUP_SHARDS, SAMPLE = 2 << 20, 1 << 20, 16, 128
PACKED = "shard long, ids binary, dim int, vectors binary"


def usable(vector: Column, zero: bool) -> Column:
    """Not null or empty, all components present and finite (and one not zero)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & (F.lit(zero) | F.exists(vector, lambda x: x != 0)), F.lit(False))


def distinct_vectors(table: DataFrame, zero: bool) -> DataFrame:
    """``vec_id, v``: usable rows, one for each id (of several, the least vector)."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where("vec_id is not null").where(usable(F.col("v"), zero)).groupBy("vec_id").agg(F.min("v").alias("v"))


def packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows(vec_id, v)``, read twice, in shards of about ``size`` bytes with one dimension each."""
    total = rows.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    shards = max(1, -(-8 * total // size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .ngram_join import runs

        for (shard, dim), t in runs(batches, 2):
            ids = t.column(2).to_numpy()
            v = t.column(3).combine_chunks().flatten().to_numpy()
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["shard", "ids", "dim", "vectors"])

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.size("v").alias("dim"), "vec_id", "v")
    return dealt.repartition("shard").sortWithinPartitions("shard", "dim", "vec_id").mapInArrow(run, PACKED), shards


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a (n, dim) matrix of one packed row."""
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    return ids, np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(ids), -1)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed alike for equal rows."""
    return np.einsum("ij,ij->i", a, b)


def sampled(ids: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k``-th score among the first ``SAMPLE`` rows, and the ids and scores of its ``k`` best there (none: -inf)."""
    own, v = own[:SAMPLE], v[:SAMPLE]
    scores = q @ v.T
    scores[ids[:, None] == own[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
    there = np.take_along_axis(scores, order, axis=1) > -np.inf
    top = np.where(there, dot(np.repeat(q, order.shape[1], axis=0), v[order.ravel()]).reshape(order.shape), -np.inf)
    if top.shape[1] < k:
        fill = ((0, 0), (0, k - top.shape[1]))
        order, top = np.pad(order, fill), np.pad(top, fill, constant_values=-np.inf)
    return top[:, k - 1].copy(), own[order], top


def with_floors(blocks: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Adds ``extra``: what a small sample of the table (one a dimension, of bounded size) tells of each query.

    That is the score that ``k`` other vectors reach, and its ``k`` best there, which
    are results like any other: a search that finds nothing better still has them.
    """
    sample = index.groupBy("dim").agg(F.max_by(F.struct("ids", "vectors", "shard"), F.struct(F.length("ids"), "shard")).alias("s"))
    width = 8 * SAMPLE
    sample = sample.select("dim", F.substring("s.ids", 1, width).alias("known_ids"), F.expr(f"substring(s.vectors, 1, {width} * dim)").alias("known"), F.col("s.shard").alias("known_shard"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("dim", pa.int32()), ("vectors", pa.binary()), ("extra", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, q = unpack(row)
                own, v = unpack({"ids": row.pop("known_ids"), "vectors": row.pop("known")})
                floor, names, scores = sampled(ids, q, own, v, k)
                row["extra"] = b"".join([np.int64(row.pop("known_shard")).tobytes(), floor.tobytes(), names.astype(np.int64).tobytes(), scores.astype(np.float64).tobytes()])
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    # as many rows as there are dimensions, each of SAMPLE vectors
    return blocks.join(F.broadcast(sample), "dim").select("shard", "ids", "dim", "vectors", "known_ids", "known", "known_shard").mapInArrow(run, PACKED + ", extra binary")


def told(extra: bytes, n: int, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`with_floors` packed for ``n`` queries."""
    at = 8 + 8 * n
    ids = np.frombuffer(extra, dtype=np.int64, offset=at, count=n * k).reshape(n, k)
    return int(np.frombuffer(extra, dtype=np.int64, count=1)[0]), np.frombuffer(extra, dtype=np.float64, offset=8, count=n), ids, np.frombuffer(extra, dtype=np.float64, offset=at + 8 * n * k).reshape(n, k)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)]))
    return order[rank < k]


def raised(floor: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Each query's ``k``-th highest of some scores, where that is above its floor."""
    order = np.lexsort((-score, query))
    who, first = np.unique(query[order], return_index=True)
    full = np.diff([*first, len(order)]) >= k
    floor = floor.copy()
    floor[who[full]] = np.maximum(floor[who[full]], score[order][first[full] + k - 1])
    return floor


def top_k(queries: DataFrame, index: DataFrame, shards: int, k: int, open_shard: Callable, search: Callable, kind: str) -> DataFrame:
    """Each query's ``k`` best over all shards, from the groups' own bests.

    ``queries`` and ``index`` are packed; ``index`` has ``extra`` as well.
    ``open_shard(v, extra)`` prepares a shard once, ``search(shard, q, floor, own)``
    gives pairs (query, row) and their scores; rows whose score is below a
    query's floor need not be among them, ``own`` is a query's own row or -1.
    Where that may lose some (scores in double), the sample's best join the results
    of the group that holds the sample's shard, so every query has ``k`` results, or
    all candidates if there are fewer.
    """
    parallel = 4 * index.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-shards // GROUP_SHARDS), min(shards, parallel))
    asked = with_floors(queries, index, k).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    own = index.withColumn("grp", F.pmod("shard", F.lit(groups)))
    sides = [df.select("dim", F.col("grp").cast("int").alias("grp"), F.lit(n).alias("kind"), "shard", "ids", "vectors", "extra") for n, df in enumerate((own, asked))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opened = None, []  # a group's shards come before its queries
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["dim"], row["grp"]) != at:
                    at, opened = (row["dim"], row["grp"]), []
                ids, v = unpack(row)
                if row["kind"] == 0:
                    opened.append((ids, open_shard(v, row["extra"])))
                    continue
                known_shard, floor, known, known_score = told(row["extra"], len(ids), k)
                number = np.int64 if kind == "long" else np.float64
                who, to, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, number)
                here = kind == "double" and known_shard % groups == row["grp"]  # whole scores come from the exact search alone
                if here:
                    who, place = np.nonzero(known_score > -np.inf)
                    to, score = known[who, place], known_score[who, place]
                for names, shard in opened:
                    order = np.argsort(names, kind="stable")
                    place = order[np.minimum(np.searchsorted(names[order], ids), len(names) - 1)]
                    a, b, s = search(shard, v, floor, np.where(names[place] == ids, place, -1))
                    who, to, score = np.concatenate([who, a]), np.concatenate([to, names[b]]), np.concatenate([score, s])
                    if here:  # the sample's rows are met again in their shard
                        order = np.lexsort((to, who))
                        new = np.r_[True, (who[order][1:] != who[order][:-1]) | (to[order][1:] != to[order][:-1])] if len(who) else np.zeros(0, bool)
                        who, to, score = who[order][new], to[order][new], score[order][new]
                    keep = best(who, to, score, k)
                    who, to, score = who[keep], to[keep], score[keep]
                    floor = raised(floor, who, score, k)
                yield pa.record_batch([pa.array(ids[who]), pa.array(to), pa.array(score)], names=["query_id", "vec_id", "score"])

    met = sides[0].unionByName(sides[1]).repartitionById(groups, F.col("grp")).sortWithinPartitions("dim", "grp", "kind", "shard")
    found = met.mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
