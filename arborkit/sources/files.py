"""Tables of whole files ``(name, content)``: read, written and decoded one file a row.

Formats are pairs of plain functions over bytes; these helpers run them inside
Arrow batches, so that a folder of files is a distributed scan and a table of
neurons or volumes a distributed sink.
"""

from __future__ import annotations

import gzip
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Rows in a part of a file (a multiple of 2, 3, 4, 5 and 50: pieces of several rows stay whole).
PART_ROWS = 30_000
PART = "name string, section int, part long, start long, content binary"

_LOCAL_FOLDER: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder (a local one only where none is set on one machine)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/arborkit-{context.applicationId}"
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append("file://" + tempfile.mkdtemp(prefix="arborkit-"))
    return _LOCAL_FOLDER[0]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's name in :func:`scratch_folder`."""
    return f"{scratch_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application wrote on the way, once its results are saved elsewhere."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _LOCAL_FOLDER.clear()


def lists(t: pa.Table, columns: Iterable[str]) -> dict[str, list]:
    """Columns as lists, through numpy where whole numbers or floats have no nulls (many times faster)."""
    plain = lambda c: not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
    return {x: c.to_numpy().tolist() if plain(c := t.column(x)) else c.to_pylist() for x in columns}


def files(spark: SparkSession, path: str) -> DataFrame:
    """``name, content, modified, size`` of every file under a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def write_files(table: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Write ``(name, content)`` rows into a folder that all workers share; ``name, written``.

    Existing files stay (``written`` false) unless ``force``.  A file gets its name once
    it is whole, so a task that is run again finds no half of one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath

        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        for batch in batches:
            done = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                to = posixpath.join(base, name)
                free = force or place.get_file_info(to).type == fs.FileType.NotFound
                if free:
                    place.create_dir(posixpath.dirname(to), recursive=True)
                    part = f"{to}.{uuid.uuid4().hex}.part"
                    with place.open_output_stream(part, compression=None) as f:
                        f.write(content)
                    place.move(part, to)
                done.append(free)
            yield pa.record_batch([batch.column(0), pa.array(done, pa.bool_())], names=["name", "written"])

    return table.select("name", "content").mapInArrow(run, "name string, written boolean")


def decoded(table: DataFrame, decode: Callable[[str, bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that ``decode(name, content)`` gives for every file, after its name; gzip is undone."""
    kinds = to_arrow_schema(StructType.fromDDL("name string, " + schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [(name, *row) for row in decode(name, plain)]
                for lo in range(0, len(rows), 10_000):
                    columns = zip(*rows[lo : lo + 10_000])
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return table.select("name", "content").mapInArrow(run, "name string, " + schema)


def encoded(rows: DataFrame, key: str, order: list[str], columns: list[str], encode: Callable[[dict[str, list]], bytes], suffix: str) -> DataFrame:
    """One file a key: ``encode`` of its rows' columns as lists, in order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order]) if order else t
        content = encode(lists(t, [key, *columns]))
        return pa.table({"name": [f"{t.column(key)[0].as_py()}{suffix}"], "content": pa.array([content], pa.binary())})

    return rows.select(*dict.fromkeys([key, *order, *columns])).groupBy(key).applyInArrow(run, "name string, content binary")


# ------------------------------------------------------------------ files of any size
def encoded_parts(rows: DataFrame, key: str, number: str, columns: list[str], sections: list[tuple[Callable[[int], bytes], Callable[[dict[str, list]], bytes] | None]], suffix: str, size: int = PART_ROWS) -> DataFrame:
    """One file a key in parts ``name, section, part, start, content``, which a file holds in that order.

    ``number`` counts a key's rows from 1.  A section is what it begins with, made from
    the number of rows (part 0), and an encoder of some rows, in order (or None): parts
    from 1 hold ``size`` rows each, ``start`` being the number of rows before.  No task
    holds more than one part, so a file may have any size.
    """
    kind = rows.schema[key].dataType.simpleString()

    def bodies(t: pa.Table) -> pa.Table:
        t = t.sort_by(number)
        part = t.column("_part")[0].as_py()
        c = lists(t, [key, *columns])
        made = [(i, encode(c)) for i, (_, encode) in enumerate(sections) if encode]
        n = len(made)
        name = f"{c[key][0]}{suffix}"
        return pa.table({"name": [name] * n, "section": pa.array([i for i, _ in made], pa.int32()), "part": [part + 1] * n, "start": [part * size] * n, "content": pa.array([x for _, x in made], pa.binary())})

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(f"{k}{suffix}", i, 0, 0, head(n)) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (head, _) in enumerate(sections)]
            if made:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*made), kinds)], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(PART))
    dealt = rows.select(*dict.fromkeys([key, number, *columns])).withColumn("_part", F.floor((F.col(number) - 1) / size).cast("long"))
    counts = rows.groupBy(F.col(key).cast(kind).alias("key")).agg(F.count("*").alias("n"))
    return counts.mapInArrow(heads, PART).unionByName(dealt.groupBy(key, "_part").applyInArrow(bodies, PART))


def decoded_parts(parts: DataFrame, decode: Callable[[int, int, int, bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that ``decode(section, part, start, content)`` gives for every part, after the file's name."""
    kinds = to_arrow_schema(StructType.fromDDL("name string, " + schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, *part = (batch.column(c)[at].as_py() for c in range(5))
                rows = list(decode(*part))
                for lo in range(0, len(rows), 10_000):
                    lot = rows[lo : lo + 10_000]
                    columns = [[name] * len(lot), *zip(*lot)]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return parts.select("name", "section", "part", "start", "content").mapInArrow(run, "name string, " + schema)


def write_parts(parts: DataFrame, folder: str) -> DataFrame:
    """Write files that come in parts into a folder that all workers share; ``name, written`` (false: it was there).

    A file's parts stream through one task in order; it gets its name once it is whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath

        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        name = stream = part = None

        def done():
            if stream is not None:
                stream.close()
                place.move(part, posixpath.join(base, name))
            return pa.record_batch([pa.array([name]), pa.array([stream is not None])], names=["name", "written"])

        for batch in batches:
            for at in range(batch.num_rows):
                own = batch.column(0)[at].as_py()
                if own != name:
                    if name is not None:
                        yield done()
                    name, stream, to = own, None, posixpath.join(base, own)
                    if place.get_file_info(to).type == fs.FileType.NotFound:
                        place.create_dir(posixpath.dirname(to), recursive=True)
                        part = f"{to}.{uuid.uuid4().hex}.part"
                        stream = place.open_output_stream(part, compression=None)
                if stream is not None:
                    stream.write(batch.column(1)[at].as_buffer())
        if name is not None:
            yield done()

    ordered = parts.repartition("name").sortWithinPartitions("name", "section", "part")
    return ordered.select("name", "content").mapInArrow(run, "name string, written boolean")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """``name, row, value`` of every line (rows from 0) of text files under a folder, each read by several tasks."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder)
    text = text.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # a block's lines come together
        for batch in batches:
            codes = np.stack([batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in (0, 1)])
            cuts = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0), True][: batch.num_rows + 1]) if batch.num_rows else []
            at = np.empty(batch.num_rows, dtype=np.int64)
            for lo, hi in zip(cuts, cuts[1:]):
                key = (batch.column(0)[int(lo)].as_py(), batch.column(1)[int(lo)].as_py())
                last, seen = (key, seen) if key == last else (key, 0)
                at[lo:hi] = np.arange(seen, seen + hi - lo)
                seen += hi - lo
            yield pa.record_batch([*batch.columns, pa.array(at)], names=["name", "block", "value", "at"])

    own = text.mapInArrow(run, "name string, block long, value string, at long")
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block of a file: their running sum is small
    starts = text.groupBy("name", "block").agg(F.count("*").alias("n")).select("name", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return own.join(F.broadcast(starts), ["name", "block"]).select("name", (F.col("start") + F.col("at")).alias("row"), "value")
