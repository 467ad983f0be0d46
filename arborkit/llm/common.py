"""Shared plumbing: shared-folder tables, word hashing, repeat sketches, components.

Everything that outlives one task goes through DataFrames or tables written to
the cluster's shared checkpoint folder, so a lost executor costs a recompute
and never a result.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_FOLDER: list[str] = []
U64 = np.uint64
#: Odd multiplier of the rolling polynomial hash and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Characters of text that one worker holds tokenised at a time.
CHUNK_CHARS = 4_000_000


# ---------------------------------------------------------------- shared tables
def shared_folder(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder; a local one only where none is set on one machine (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/arborkit-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append("file://" + tempfile.mkdtemp(prefix="arborkit-"))
    return _LOCAL_FOLDER[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing will read again."""
    path = getattr(df, "_shared_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of steps whose results are written.

    It does so when the driver's JVM finds their plans unreachable, which a driver
    with little to do may put off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables that this application wrote, once its results are saved elsewhere."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _LOCAL_FOLDER.clear()


#: Name under which :func:`boxed` carries the columns that a function does not read.
BOX = "__row"


def boxed(docs: DataFrame, *read: str) -> DataFrame:
    """Columns ``read`` and all others in one struct, so that no added column can clash."""
    others = [c for c in docs.columns if c not in read]
    return docs.select(*[F.col(f"`{c}`") for c in read], F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(others)]).alias(BOX))


def unboxed(judged: DataFrame, columns: list[str], read: Iterable[str], *added: str, **new) -> DataFrame:
    """``columns`` of a table boxed with ``read``, ``new`` ones in place of those of that name, and ``added`` ones."""
    read = list(read)
    others = [c for c in columns if c not in read]
    place = {c: i for i, c in enumerate(others)}
    own = [new[c].alias(c) if c in new else F.col(f"`{c}`") if c in read else F.col(BOX)[f"f{place[c]}"].alias(c) for c in columns]
    return judged.select(*own, *added)


def schema_of(df: DataFrame, columns: list[str], added: str) -> T.StructType:
    """Some columns of ``df`` and the DDL of what a function adds."""
    own = {f.name: f for f in df.schema.fields}
    return T.StructType([own[c] for c in columns] + T.StructType.fromDDL(added).fields)


# ------------------------------------------------------------------ text hashing
class WordHashes(dict):
    """Word bytes to 64-bit hash, remembered up to a bound."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORD_HASHES = WordHashes()


def ascii_words(text: str | None) -> list[bytes]:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``: what bytes.split() separates."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD_HASHES.__getitem__, words), dtype=U64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (the published splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` consecutive words (by start)."""
    n = len(word_hashes)
    if n < k:
        return np.zeros(0, dtype=U64)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(word_hashes * _powers(_P, n), out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * _powers(_P_INV, n - k + 1) + U64(k))


def chunked(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of a batch that hold about ``limit`` characters (one text at least)."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text) if text else 0
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller ones, so that few texts at a time are Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


# ---------------------------------------------------------------- repeat sketch
def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending uint32 as 16-bit gaps where they fit, after a byte that says which."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return b"\x02" + gaps.astype(np.uint16).tobytes() if gaps.max(initial=0) < 1 << 16 else b"\x04" + values.tobytes()


def unpack_ascending(data: bytes | pa.Buffer) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if raw[0] == 2:
        return np.cumsum(np.frombuffer(data, dtype=np.uint16, offset=1), dtype=np.uint32)
    return np.frombuffer(data, dtype=np.uint32, offset=1)


class RepeatSketch:
    """Count-min sketch whose counters saturate at two.

    ``depth`` rows of ``2**bits`` counters.  Partitions send the sorted counters
    that they touched, cut into blocks; blocks are merged by streaming, and only
    the bitmap "count reached two" (depth * 2**bits / 8 bytes, fixed by ``bits``)
    goes to the driver and from there to workers.  Estimates never fall short.
    """

    depth = 2
    block_bits = 18

    def __init__(self, bits: int):
        self.bits = max(bits, self.block_bits)

    @classmethod
    def for_items(cls, items: float, max_bits: int = 30) -> RepeatSketch:
        """Eight counters an item, up to ``2**max_bits`` counters a row."""
        return cls(min(max_bits, max(18, int(np.ceil(np.log2(8 * max(1.0, items)))))))

    def slots(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (mix64(keys + U64(0x632BE59BD9B4E019 * (row + 1) % 2**64)) >> U64(64 - self.bits)).astype(np.uint32)

    def emit(self, keys: np.ndarray) -> pa.RecordBatch:
        """Block rows of one part's keys (repeats in the part already count)."""
        slot_column, payloads = [], []
        for row in range(self.depth):
            touched, counts = np.unique(self.slots(keys, row), return_counts=True)
            blocks = touched >> self.block_bits
            offsets = ((touched & ((1 << self.block_bits) - 1)) << 1 | (counts > 1)).astype(np.uint32)
            names, starts = np.unique(blocks, return_index=True)
            for name, lo, hi in zip(names, starts, [*starts[1:], len(blocks)]):
                slot_column.append(row << 32 | int(name))
                payloads.append(pack_ascending(offsets[lo:hi]))
        return pa.record_batch([pa.array(slot_column, pa.int64()), pa.array(payloads, pa.binary())], names=["block", "part"])

    def merge(self, parts: DataFrame) -> np.ndarray:
        """Bitmaps (depth, 2**bits / 8) of the counters that reached two."""
        width = 1 << self.block_bits

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, counts = None, np.zeros(width, dtype=np.uint8)

            def out():
                return pa.record_batch([pa.array([current], pa.int64()), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary())], names=["block", "part"])

            for batch in batches:
                for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if block != current:
                        if current is not None:
                            yield out()
                        current, counts = block, np.zeros(width, dtype=np.uint8)
                    data = unpack_ascending(part.as_buffer())
                    at = data >> 1
                    counts[at] = np.minimum(counts[at] + 1 + (data & 1), 2)
            if current is not None:
                yield out()

        merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, part binary")
        table = np.zeros((self.depth, 1 << (self.bits - 3)), dtype=np.uint8)
        for block, part in merged.collect():  # size fixed by bits
            lo = (block & 0xFFFFFFFF) << (self.block_bits - 3)
            table[block >> 32, lo : lo + (width >> 3)] = np.frombuffer(part, dtype=np.uint8)
        return table

    def repeated(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """True where the estimate is two or more."""
        found = np.ones(len(keys), dtype=bool)
        for row in range(self.depth):
            at = self.slots(keys, row)
            found &= (table[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


# ------------------------------------------------------------------- components
def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Components of an undirected graph, by alternating star contractions.

    ``edges(a long, b long)``; returns ``(node, component)`` for every node of an
    edge between two different nodes, ``component`` being the smallest node id.
    Each step is two aggregations by key with map-side minima, each written
    before it meets the edges again: both sides of that join are then plain
    shuffles (or the minima are small enough to broadcast), which adaptive
    execution splits where a hub makes one partition large.  Labels are written
    to the shared folder between steps.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(high.alias("a"), low.alias("b")).distinct(), tag)
    state = None
    while True:
        # Large star: each node's larger neighbours join the smallest node seen.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), tag + "-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each node and its smaller neighbours join the smallest.
        large = materialize(large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag + "-large")
        low_of = materialize(large.groupBy("a").agg(F.min("b").alias("m")), tag + "-low")
        small = large.join(low_of, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = materialize(small.where("a <> b").distinct(), tag)
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first()
        for old in (now, least, large, low_of):
            discard(old)
        now = after
        if tuple(seen) == state or seen[0] == seen[2] and not after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
        state = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ---------------------------------------------------------------- word-part cache
class PartCache(dict):
    """Encodings of word parts, kept in two generations of bounded size."""

    def __init__(self, learn, generation: int = 450_000):
        super().__init__()
        self.learn, self.generation = learn, generation
        self.before: dict = {}

    def __missing__(self, part: str):
        value = self.before.get(part)
        if value is None:
            value = self.learn(part)
        if len(self) >= self.generation:
            self.before = dict(self)
            self.clear()
        self[part] = value
        return value


#: Marks a part that no space precedes, in :func:`spaced_parts`.
BARE = "\x00"


def spaced_parts(text: str) -> list[str]:
    """Parts between single spaces and line feeds: ``\\n``, BARE + x, or x (space-led).

    For texts without BARE in which no white space touches another or an end.
    """
    return (BARE + text.replace("\n", " \n " + BARE)).split(" ")
