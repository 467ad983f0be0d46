"""SWC files: whitespace-separated points, ``#`` comments; a radius is read as a diameter."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "neuron_id"
#: Before the neuron of a file that :func:`write_swc` wrote, as of a folder: names may hold anything and none is hidden.
NAMED, NO_NAME = f"{KEY}=", "__HIVE_DEFAULT_PARTITION__"


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """Point table of all files under ``path``; ``neuron_id`` is the file's name, or as files or folders ``neuron_id=..`` name it."""
    text = spark.read.text(path)
    file = F.col(KEY).cast("string") if KEY in text.columns else F.col("_metadata.file_name")
    lines = text.select(F.trim("value").alias("line"), file.alias("file"))
    f = F.split(F.col("line"), r"\s+")
    rows = lines.where("line <> '' and not startswith(line, '#')")
    names = ("point_no int", "label int", "x double", "y double", "z double", "w double", "parent int")
    columns = [f.getItem(i).try_cast(t.split()[1]).alias(t.split()[0]) for i, t in enumerate(names)]
    name = F.regexp_replace("file", r"\.swc$", "")
    own = F.nullif(F.substring(name, len(NAMED) + 1, 1 << 30), F.lit(NO_NAME))
    out = rows.select(F.when(F.startswith("file", F.lit(NAMED)), F.try_url_decode(own if KEY in text.columns else F.try_url_decode(own))).otherwise(name).alias("neuron_id"), *columns)
    return out.withColumn("w", 2 * F.col("w"))


def write_swc(points: DataFrame, path: str) -> None:
    """One file ``neuron_id=<id>.swc`` per neuron with its points in order (diameter back to radius), in a new folder.

    A neuron's lines stream through one task.  The folder gets its name once all files
    are whole.  Stores that pyarrow does not open get a folder per neuron, by Spark's
    writer, which makes, moves and lists them one by one.
    """
    spark = points.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    columns = ["point_no", "label", "x", "y", "z", (F.col("w") / 2).alias("r"), "parent"]
    rows = points.select(F.col(KEY).cast("string").alias(KEY), "point_no", F.concat_ws(" ", *columns).alias("line"))
    rows = rows.repartition(KEY).sortWithinPartitions(KEY, "point_no").select(KEY, "line")
    where = store.makeQualified(where)
    part = where.suffix(f".{uuid.uuid4().hex}.part")
    local = where.toUri().getScheme() == "file"
    folder = "file://" + part.toUri().getPath() if local else part.toString()
    try:
        if not local:
            fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        rows.write.partitionBy(KEY).text(path)
        return
    if store.exists(where):
        raise FileExistsError(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(folder) if not local else (fs.LocalFileSystem(), folder.removeprefix("file://"))
        whole, name, stream, temporary = 0, None, None, ""

        def done() -> int:
            stream.close()
            place.move(temporary, f"{base}/{NAMED}{NO_NAME if name is None else quote(name, safe='')}.swc")
            return 1

        for batch in batches:
            ends = pc.run_end_encode(batch.column(0))
            lo = 0
            for own, hi in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                if stream is None or own != name:
                    whole += done() if stream else 0
                    name, temporary = own, f"{base}/_{uuid.uuid4().hex}.part"
                    stream = place.open_output_stream(temporary, compression=None)
                stream.write("".join(f"{x}\n" for x in batch.column(1).slice(lo, hi - lo).to_pylist()).encode())
                lo = hi
        whole += done() if stream else 0
        yield pa.record_batch([pa.array([whole], pa.int64())], names=["files"])

    store.mkdirs(part)
    rows.mapInArrow(run, "files long").agg(F.sum("files")).collect()
    if not store.rename(part, where):
        raise OSError(f"{part} cannot be renamed to {where}")


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """ASCII landmark sets: ``set_no, marker_no, x, y, z`` of each ``@n`` section."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("pair_id"), "value")
    parts = whole.select("pair_id", F.posexplode(F.expr(r"slice(split(value, '(?m)^@\\d+\\s*$'), 2, 2147483647)")).alias("set", "body"))
    lines = parts.select("pair_id", (F.col("set") + 1).alias("set_no"), F.posexplode(F.filter(F.split(F.trim("body"), "\n"), lambda l: F.trim(l) != "")).alias("marker_no", "line"))
    f = F.split(F.trim("line"), r"\s+")
    return lines.select("pair_id", "set_no", (F.col("marker_no") + 1).alias("marker_no"), *[f.getItem(i).try_cast("double").alias(a) for i, a in enumerate("xyz")])
