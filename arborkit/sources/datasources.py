"""Volumes and folders of files as Spark data sources.

``spark.read.format("arborkit_volumes")`` reads lattices, NRRD files and raw stacks
as voxels ``name, i, j, k, value``.  A large file whose values lie plainly in it is
planned as slabs of whole planes, each read by its own task with one positioned read;
compressed and text files are read whole, several small ones to a task.  Only the
columns of the given schema are made; where the session pushes filters to Python
sources, bounds on ``k`` and names leave out slabs and files.  ``df.write.format("arborkit_files")`` writes ``name, content`` rows: tasks
write under a temporary name, and the commit renames all of them or none.

Both reach files through pyarrow; what only Spark can open is read with
:func:`arborkit.sources.files.files` instead.
"""

from __future__ import annotations

import gzip
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from . import formats as f

VOLUMES, FILES = "arborkit_volumes", "arborkit_files"
SCHEMA = StructType([StructField("name", StringType()), *[StructField(c, IntegerType()) for c in "ijk"], StructField("value", DoubleType())])
#: Bytes of a slab (option ``slab_bytes``), of a file's beginning that tells its layout, and rows of a batch.
SLAB, HEAD, ROWS = 32 << 20, 1 << 16, 1 << 16


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + posixpath.abspath(path))


@dataclass
class Layout:
    """Where a file keeps its values and as what; x runs fastest."""

    offset: int
    kind: str
    dims: tuple[int, ...]

    @property
    def plane(self) -> int:
        return int(np.prod(self.dims[:2])) * np.dtype(self.kind).itemsize


def layout(head: bytes) -> Layout | None:
    """The layout that a file's beginning tells, or None where values are compressed, text or elsewhere."""
    if head.startswith(b"NRRD"):
        fields, size = f.read_nrrd_header(head)
        plain = fields.get("encoding", "").lower() == "raw" and not {"datafile", "lineskip", "byteskip"} & set(fields) and size < len(head)
        if not plain or fields["dimension"] != "3":
            return None
        order = ">" if fields.get("endian") == "big" else "<"
        return Layout(size, np.dtype(f.NRRD_TYPES[f.nrrd_type(fields["type"])][0]).newbyteorder(order).str, tuple(map(int, fields["sizes"].split())))
    if head.startswith(f.RAW_MAGIC) and head[24:25] in (b"L", b"B"):
        order = "<" if head[24:25] == b"L" else ">"
        size, *dims = np.frombuffer(head[25:27], order + "i2").tolist() + np.frombuffer(head[27:43], order + "i4").tolist()
        return Layout(43, np.dtype(f.RAW_KINDS[size]).newbyteorder(order).str, tuple(dims[:3])) if size in f.RAW_KINDS and dims[3] == 1 else None
    if head[:15].lower().startswith(b"# amiramesh"):
        start = re.search(rb"(?m)^@1\b[^\n]*\n", head)
        mesh = f.read_mesh(head, only_header=True)
        first = head.split(b"\n", 1)[0].lower()
        dims, values = mesh["sizes"].get("Lattice", []), [s for s in mesh["sections"] if s["number"] == 1]
        if start and b"binary" in first and len(dims) == 3 and values and not values[0]["how"] and values[0]["width"] == 1:
            return Layout(start.end(), np.dtype(f.MESH_TYPES[values[0]["kind"]]).newbyteorder("<" if b"little" in first else ">").str, tuple(dims))
    return None


def whole(data: bytes) -> np.ndarray:
    """All values of a volume file, three axes."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    if data.startswith(b"NRRD"):
        values = f.read_nrrd(data)[1]
    elif data.startswith(f.RAW_MAGIC):
        values = f.read_raw_stack(data)
    else:
        mesh = f.read_mesh(data)
        values = mesh["sections"][0]["values"][:, 0].reshape(mesh["sizes"]["Lattice"], order="F")
    return np.asarray(values, dtype=float).reshape([*values.shape, 1, 1, 1][:3])


@dataclass
class Slab(InputPartition):
    """Planes ``low..high`` of one file, or (without a layout) whole files."""

    paths: list[str]
    layout: Layout | None = None
    low: int = 0
    high: int = 0

    def __post_init__(self):
        super().__init__(None)


class VolumeReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, slab: int):
        self.path, self.columns, self.slab = path, schema.fieldNames(), slab
        unknown = set(self.columns) - set(SCHEMA.fieldNames())
        if unknown:
            raise ValueError(f"volumes have no columns {sorted(unknown)}")
        self.low, self.high, self.names = 0, None, None

    def partitions(self) -> list[Slab]:
        from pyarrow import fs

        place, base = _opened(self.path)
        found = [place.get_file_info(base)]
        if found[0].type == fs.FileType.Directory:
            found = place.get_file_info(fs.FileSelector(base, recursive=True))
        elif found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out, small, size = [], [], 0
        for info in sorted(found, key=lambda x: x.path):
            if info.type != fs.FileType.File or info.base_name[:1] in "_." or self.names is not None and info.base_name not in self.names:
                continue
            plan = None
            if info.size > self.slab:  # only large files are looked into here
                with place.open_input_file(info.path) as file:
                    plan = layout(file.read_at(min(HEAD, info.size), 0))
            if plan is None:
                if small and size + info.size > self.slab:
                    out.append(Slab(small))
                    small, size = [], 0
                small.append(info.path)
                size += info.size
                continue
            step, last = max(1, self.slab // plan.plane), plan.dims[2] if self.high is None else min(plan.dims[2], self.high + 1)
            out += [Slab([info.path], plan, k, min(k + step, last)) for k in range(self.low, last, step)]
        return out + ([Slab(small)] if small else []) or [Slab([])]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        place, _ = _opened(self.path)
        for path in partition.paths:
            name = posixpath.basename(path)
            with place.open_input_file(path) as file:
                if partition.layout is None:
                    values = whole(file.read())
                    low, high = self.low, values.shape[2] if self.high is None else min(values.shape[2], self.high + 1)
                    yield from self._rows(name, values.shape, low, values[:, :, low : max(low, high)].ravel(order="F"))
                else:
                    plan = partition.layout
                    size = (partition.high - partition.low) * plan.plane
                    raw = file.read_at(size, plan.offset + partition.low * plan.plane)
                    if len(raw) < size:
                        raise f.FormatError(f"{path} ends within plane {partition.low + len(raw) // plan.plane}")
                    yield from self._rows(name, plan.dims, partition.low, np.frombuffer(raw, dtype=plan.kind))

    def _rows(self, name: str, dims: tuple[int, ...], low: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        nx, ny = dims[:2]
        for start in range(0, len(values), ROWS):
            at = np.arange(start, min(start + ROWS, len(values)), dtype=np.int64)
            made = {
                "name": lambda: pa.array([name] * len(at), pa.string()), "i": lambda: pa.array((at % nx).astype(np.int32)), "j": lambda: pa.array((at // nx % ny).astype(np.int32)),
                "k": lambda: pa.array((low + at // (nx * ny)).astype(np.int32)), "value": lambda: pa.array(values[at].astype(np.float64)),
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


class FilteredReader(VolumeReader):
    """Reader for sessions that push filters down to Python sources (Spark refuses such readers in others)."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on ``k`` and names are remembered; Spark applies all filters again."""
        for one in filters:
            if one.attribute == ("k",):
                low = {GreaterThan: lambda v: v + 1, GreaterThanOrEqual: lambda v: v, EqualTo: lambda v: v}.get(type(one))
                high = {LessThan: lambda v: v - 1, LessThanOrEqual: lambda v: v, EqualTo: lambda v: v}.get(type(one))
                if low:
                    self.low = max(self.low, int(low(one.value)))
                if high:
                    top = int(high(one.value))
                    self.high = top if self.high is None else min(self.high, top)
            elif one.attribute == ("name",) and isinstance(one, (EqualTo, In)):
                held = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.names = held if self.names is None else self.names & held
            yield one


class VolumeSource(DataSource):
    """Voxels of lattices, NRRD files and raw stacks; options ``path``, ``slab_bytes`` and ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return VOLUMES

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> VolumeReader:
        kind = FilteredReader if self.options.get("pushdown", "false").lower() == "true" else VolumeReader
        return kind(self.options["path"], schema, int(self.options.get("slab_bytes", SLAB)))


# ------------------------------------------------------------------------------ sink
@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.work = path, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        place, base = _opened(self.path)
        out = Written()
        for row in iterator:
            if row.name is None or row.content is None:
                raise ValueError("files need a name and a content")
            temporary = posixpath.join(base, self.work, uuid.uuid4().hex)
            place.create_dir(posixpath.dirname(temporary), recursive=True)
            with place.open_output_stream(temporary, compression=None) as file:
                file.write(bytes(row.content))
            out.files.append((temporary, posixpath.join(base, row.name)))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """Rename all files; names that are taken or given twice are an error before any is renamed."""
        from pyarrow import fs

        place, base = _opened(self.path)
        files = [x for m in messages if m for x in m.files]
        targets = [to for _, to in files]
        twice = {to for to in targets if targets.count(to) > 1} if len(set(targets)) < len(targets) else set()
        taken = [] if self.overwrite or not targets else [x.path for x in place.get_file_info(targets) if x.type != fs.FileType.NotFound]
        if twice or taken:
            self.abort(messages)
            raise FileExistsError(f"{len(twice)} names given twice, {len(taken)} already there, such as {next(iter([*twice, *taken]))}")
        for folder in {posixpath.dirname(to) for to in targets}:
            place.create_dir(folder, recursive=True)
        for temporary, to in files:
            place.move(temporary, to)
        self._clear(place, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, place, base: str) -> None:
        from pyarrow import fs

        work = posixpath.join(base, self.work)
        if place.get_file_info(work).type != fs.FileType.NotFound:
            place.delete_dir(work)


class FileSink(DataSource):
    """``name, content`` rows as files under ``path``; mode overwrite replaces files of the same names."""

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def volumes(spark: SparkSession, path: str, columns: list[str] | None = None, slab_bytes: int = SLAB) -> DataFrame:
    """Voxels of all volume files under a path, with the given columns only."""
    spark.dataSource.register(VolumeSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(VOLUMES).option("slab_bytes", slab_bytes).option("pushdown", pushdown)
    return (reader.schema(StructType([SCHEMA[c] for c in columns])) if columns else reader).load(path)


def save_files(table: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write ``name, content`` rows as files, all or none."""
    table.sparkSession.dataSource.register(FileSink)
    table.select("name", "content").write.format(FILES).mode("overwrite" if overwrite else "append").save(folder)
