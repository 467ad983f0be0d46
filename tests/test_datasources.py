"""Volumes and files as data sources: slabs, pruning, commits."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborkit.sources import datasources, formats
from arborkit.sources.files import write_files


def volume(seed=0, dims=(7, 5, 12)):
    return np.floor(200 * np.random.default_rng(seed).random(dims))


def encoders():
    lattice = lambda how, order, kind: lambda v: formats.write_mesh({"Lattice": list(v.shape)}, [{"group": "Lattice", "name": "ScalarField", "kind": kind, "values": v.ravel(order="F")}], {"CoordType": "uniform"}, how, order)
    return {
        "a.nrrd": lambda v: formats.write_nrrd(v, "float", "raw", endian="big"), "b.nrrd": lambda v: formats.write_nrrd(v, "ushort", "gzip"), "c.nrrd": lambda v: formats.write_nrrd(v, "double", "text"),
        "d.raw": lambda v: formats.write_raw_stack(v, 2, False), "e.am": lattice("binary", "little", "float"), "f.am": lattice("binary", "big", "ushort"), "g.am": lattice("text", "big", "float"), "h.am": lattice("hxzip", "little", "float"),
        "i.am.gz": lambda v: gzip.compress(lattice("binary", "big", "float")(v)),
    }


@pytest.fixture
def folder(tmp_path):
    for n, (name, write) in enumerate(encoders().items()):
        (tmp_path / name).write_bytes(write(volume(n)))
    (tmp_path / "_hidden").write_bytes(b"no volume")
    return str(tmp_path)


@pytest.mark.parametrize("slab", [300, 1 << 20])
def test_every_format_reads_the_same_by_slab_and_whole(spark, folder, slab):
    rows = datasources.volumes(spark, folder, slab_bytes=slab)
    got = {}
    for r in rows.collect():
        got.setdefault(r.name, np.full((7, 5, 12), np.nan))[r.i, r.j, r.k] = r.value
    assert set(got) == set(encoders())
    for n, name in enumerate(encoders()):
        assert np.array_equal(got[name], volume(n))
    assert rows.count() == len(got) * 7 * 5 * 12


def test_one_file_is_read_by_several_tasks(spark, folder):
    reader = datasources.VolumeReader(os.path.join(folder, "a.nrrd"), datasources.SCHEMA, 300)
    slabs = reader.partitions()
    assert [(s.low, s.high) for s in slabs] == [(k, k + 2) for k in range(0, 12, 2)]
    assert datasources.volumes(spark, os.path.join(folder, "a.nrrd"), slab_bytes=300).rdd.getNumPartitions() == 6
    # files that cannot be cut go to a task together, up to a slab's size
    whole = datasources.VolumeReader(folder, datasources.SCHEMA, 1 << 20).partitions()
    assert len(whole) == 1 and len(whole[0].paths) == 9


def test_columns_and_planes_are_left_out(spark, folder):
    rows = datasources.volumes(spark, folder, columns=["k", "value"], slab_bytes=300)
    assert rows.columns == ["k", "value"]
    total = rows.groupBy("k").agg(F.sum("value").alias("s")).collect()
    assert {r.k: r.s for r in total} == {k: sum(volume(n)[:, :, k].sum() for n in range(9)) for k in range(12)}
    reader = datasources.FilteredReader(folder, datasources.StructType.fromDDL("value double"), 300)
    filters = [datasources.GreaterThan(("k",), 3), datasources.LessThanOrEqual(("k",), 6), datasources.In(("name",), ("a.nrrd", "b.nrrd"))]
    assert list(reader.pushFilters(filters)) == filters
    slabs = reader.partitions()
    assert [(os.path.basename(s.paths[0]), s.low, s.high) for s in slabs] == [("a.nrrd", 4, 6), ("a.nrrd", 6, 7), ("b.nrrd", 0, 0)]
    assert sum(b.num_rows for s in slabs for b in reader.read(s)) == 2 * 3 * 35
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = datasources.volumes(spark, folder, slab_bytes=300).where("k = 5 and name = 'd.raw'")
        assert some.agg(F.sum("value"), F.count("*")).first()[:] == (volume(3)[:, :, 5].sum(), 35)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_faults_are_told(spark, folder, tmp_path):
    data = encoders()["a.nrrd"](volume())
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.nrrd").write_bytes(data[:-100])
    with pytest.raises(Exception, match="ends within plane"):
        datasources.volumes(spark, str(tmp_path / "cut"), slab_bytes=300).count()
    with pytest.raises(ValueError, match="no columns"):
        datasources.VolumeReader(folder, datasources.StructType.fromDDL("other int"), 300)
    with pytest.raises(FileNotFoundError):
        datasources.VolumeReader(folder + "/none", datasources.StructType.fromDDL("k int"), 300).partitions()
    (tmp_path / "empty").mkdir()
    assert datasources.volumes(spark, str(tmp_path / "empty")).count() == 0


def test_files_are_saved_all_or_none(spark, tmp_path):
    rows = [(f"sub{i % 3}/f{i}.txt", f"content {i}".encode()) for i in range(20)]
    table = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    place = tmp_path / "out"
    datasources.save_files(table, str(place))
    found = {str(p.relative_to(place)): p.read_bytes() for p in place.rglob("*") if p.is_file()}
    assert found == dict(rows) and not list(place.glob("_temporary*"))
    more = spark.createDataFrame([("new.txt", b"n"), ("sub0/f0.txt", b"other")], "name string, content binary")
    with pytest.raises(Exception, match="already there"):
        datasources.save_files(more, str(place))
    assert not (place / "new.txt").exists() and (place / "sub0/f0.txt").read_bytes() == b"content 0" and not list(place.glob("_temporary*"))
    datasources.save_files(more, str(place), overwrite=True)
    assert (place / "new.txt").read_bytes() == b"n" and (place / "sub0/f0.txt").read_bytes() == b"other"
    with pytest.raises(Exception, match="given twice"):
        datasources.save_files(more.unionByName(more.limit(1)), str(tmp_path / "twice"))
    with pytest.raises(Exception, match="need a name"):
        datasources.save_files(spark.createDataFrame([("a", b"1"), (None, b"2")], "name string, content binary"), str(tmp_path / "none"))
    assert not [p for p in (tmp_path / "none").rglob("*") if p.is_file()]


def test_a_file_gets_its_name_when_whole(spark, tmp_path):
    table = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, content binary")
    assert {r.written for r in write_files(table, str(tmp_path)).collect()} == {True}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
