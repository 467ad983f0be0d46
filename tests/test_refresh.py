"""Derived tables brought up to date, contours, grids and conversions between registrations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborkit.operators import images, refresh, registration
from arborkit.sources import formats


def items(spark, values):
    return spark.createDataFrame([(k, v) for k, v in values.items()], "image string, digest string")


def test_only_what_changed_is_computed(spark, tmp_path):
    path, asked = str(tmp_path / "table"), []

    def compute(keys):
        asked.append(sorted(r.image for r in keys.collect()))
        return keys.withColumn("run", F.lit(len(asked)))

    def run(values):
        found = refresh.refreshed(spark, path, items(spark, values), compute, "image")
        return {r.image: (r.digest, r.run) for r in found.collect()}

    assert run({"a": "1", "b": "1", "c": "1"}) == {"a": ("1", 1), "b": ("1", 1), "c": ("1", 1)}
    assert run({"a": "1", "b": "2", "d": "1"}) == {"a": ("1", 1), "b": ("2", 2), "d": ("1", 2)}
    assert run({"a": "1", "b": "2", "d": "1"}) == {"a": ("1", 1), "b": ("2", 2), "d": ("1", 2)}
    assert asked == [["a", "b", "c"], ["b", "d"]]
    assert run({"a": "1"}) == {"a": ("1", 1)} and asked[2:] == [[]]
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["version-000002", "version-000003"]


def test_a_broken_run_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "table")
    refresh.refreshed(spark, path, items(spark, {"a": "1"}), lambda keys: keys.withColumn("run", F.lit(1)), "image")

    def fails(keys):
        return keys.withColumn("run", F.raise_error(F.lit("broken")).cast("int"))

    with pytest.raises(Exception, match="broken"):
        refresh.refreshed(spark, path, items(spark, {"a": "2"}), fails, "image").collect()
    (tmp_path / "table" / "version-000009").mkdir()  # begun elsewhere, never done
    assert [tuple(r) for r in refresh.latest(spark, path).select("image", "digest").collect()] == [("a", "1")]
    found = refresh.refreshed(spark, path, items(spark, {"a": "2", None: "3"}), lambda keys: keys.withColumn("run", F.lit(2)), "image")
    assert [(r.image, r.digest, r.run) for r in found.collect()] == [("a", "2", 2)]
    assert refresh.latest(spark, str(tmp_path / "none")) is None


def test_digests_do_not_depend_on_order(spark):
    rows = [("a", 1, 2.0), ("a", 2, 3.0), ("b", 2, 3.0), ("b", 1, 2.0), ("c", 1, 2.0), ("c", 2, 3.5), ("d", 1, 2.0), ("d", 2, 3.0), ("d", 2, 3.0)]
    got = {r.k: r.digest for r in refresh.digests(spark.createDataFrame(rows, "k string, bin int, count double"), "k", ["bin", "count"]).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3


def test_backgrounds_are_fitted_once(spark, tmp_path):
    def hist(counts):
        return spark.createDataFrame([(k, b, float(b + 1), float(n)) for k, own in counts.items() for b, n in enumerate(own)], "id string, bin int, hi double, count double")

    x = np.arange(60)
    bell = lambda mu: 1000 * np.exp(-((x - mu) ** 2) / 50)
    path = str(tmp_path / "fits")
    one = {r.id: r for r in refresh.refreshed_backgrounds(spark, path, hist({"a": bell(20), "b": bell(30)}), "id").collect()}
    two = {r.id: r for r in refresh.refreshed_backgrounds(spark, path, hist({"a": bell(20), "b": bell(35), "c": bell(25)}), "id").collect()}
    assert one["a"] == two["a"] and abs(two["b"].mu - 35.5) < 0.2 and abs(two["c"].mu - 25.5) < 0.2 and abs(one["b"].sigma - 5) < 0.2


def test_contours_along_z(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (1.0, 0.5), (2.0, 2.0), (0.0, 2.0)]
    rows = [("s", c, n, x, y, z) for c, z in ((1, 5.0), (2, -1.0)) for n, (x, y) in enumerate(square)] + [("s", 3, n, *square[n], 0.0) for n in range(4)] + [("s", 3, 9, None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "s string, c int, n int, x double, y double, z double")
    got = [(r.c, r.n, r.place) for r in images.contours(points, "s", "c", "n").orderBy("place").collect()]
    assert got == [(2, 0, 1), (2, 1, 2), (2, 3, 3), (2, 4, 4), (1, 0, 5), (1, 1, 6), (1, 3, 7), (1, 4, 8)]
    assert images.contours(points, "s", "c", "n", thin=False).count() == 10 and images.contours(points, "s", "c", "n", least=4).count() == 11


def test_grids_from_tables(spark):
    rows = [("a", 2, 0.0, 4.0, 3, 0.0, 3.0, 1, 0.0, 1.0), ("b", 2, 0.0, None, 3, 0.0, 3.0, 1, 0.0, 1.0), ("c", 0, 0.0, 4.0, 3, 0.0, 3.0, 1, 0.0, 1.0)]
    grids = spark.createDataFrame(rows, "g string, n_x int, low_x double, high_x double, n_y int, low_y double, high_y double, n_z int, low_z double, high_z double")
    assert [r.ok for r in grids.select(images.is_grid().alias("ok")).collect()] == [True, False, False]
    one = grids.where("g = 'a'")
    assert {(r.x, r.y, r.z) for r in images.centres(one, ["g"]).collect()} == {(x, y, 0.5) for x in (1.0, 3.0) for y in (0.5, 1.5, 2.5)}
    assert {(r.x, r.y, r.z) for r in images.meshes(one, ["g"]).collect()} == {(x, y, 0.0) for x in (0.0, 4.0) for y in (0.0, 1.5, 3.0)}
    assert images.regular_points(one, ["g"], 1.0).count() == 4 * 3 * 1 and images.regular_points(one, ["g"], 1.0, True).count() == 5 * 4 * 2
    assert images.regular_points(one, ["g"], 9.0).count() == 0
    numbers = spark.createDataFrame([(1, [2.0, 2, 2, 1, 1, 1]), (2, [2.0, 2, 2, 1, 1, 1, 5, 5, 5]), (3, [1.0])], "id int, t array<double>")
    found = {r.id: (r.n_x, r.low_x, r.high_x) for r in images.targets(numbers, "t", ["id"]).collect()}
    assert found == {1: (2, -0.5, 1.5), 2: (2, 4.5, 6.5), 3: (None, None, None)}


@pytest.mark.parametrize("invert", [False, True])
def test_registrations_between_tools(invert):
    m = registration.compose([[3, 4, 5], [10, 20, -15], [1.2, 0.8, 1.1], [0.02, 0.01, 0.03], [1, 2, 3]])
    text = formats.write_transform_text(m, invert=invert)
    assert len(text.split()) == 16
    back = formats.read_transform_text(text, invert=invert)
    again = registration.matrix_of(formats.read_typed_stream(formats.write_typed_stream(registration.registration(registration.decompose(back)))))
    assert np.allclose(back, m, atol=1e-6) and np.allclose(again, m, atol=1e-5)


def test_tables_on_the_way_can_be_cleared(spark):
    from arborkit.sources import files

    path = files.scratch(spark, "some")
    spark.range(3).write.parquet(path)
    assert path.startswith(files.scratch_folder(spark) + "/some-") and files.scratch(spark, "some") != path
    files.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_sums_to_root_of_deep_broken_and_cyclic_trees(spark):
    from arborkit.operators import tree

    chain = [("deep", n, n - 1 if n > 1 else -1) for n in range(1, 301)]
    rows = [*chain, ("cycle", 1, 2), ("cycle", 2, 1), ("cycle", 3, 2), ("lost", 1, 9), ("lost", 2, -1), ("lost", 3, 2)]
    points = spark.createDataFrame(rows, "neuron_id string, point_no int, parent int")
    got = {(r.neuron_id, r.point_no): r.depth for r in tree.depths(points).collect()}
    assert got == {**{("deep", n): n - 1 for n in range(1, 301)}, ("lost", 2): 0, ("lost", 3): 1}
