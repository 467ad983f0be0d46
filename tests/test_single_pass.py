"""Queries that made their points several times make them as often as they must."""

from pyspark.sql import functions as F

from arborkit import catalog
from arborkit.functions import texts
from arborkit.operators import rendering as rd

SF = "/root/testdata/sf0.001"


def windows(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    return plan.count("Window [")


def test_points_are_turned_in_one_pass(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0, "a"), (2, -1.0, 7.5, None)], "point_no int, x double, y double, kind string")
    found = texts.turned_each(rows, "hvlr", (25.0, 55.0))
    for how in "hvlr":
        want = texts.turned(rows, how, (25.0, 55.0)).collect()
        assert sorted(found.where(F.col("how") == how).select(*rows.columns).collect()) == sorted(want)
    assert windows(spark, "coordinates_turned") == 1


def test_pieces_of_scenes_make_points_twice(spark):
    assert windows(spark, "scene_cylinders") == windows(spark, "scene_blended_cones") == 2


def test_moved_cones_equal_blended_cones(spark):
    ends = [a + e for e in "01" for a in "xyz"]
    rows = spark.createDataFrame([(1, n, *[float(n + i) for i in range(8)]) for n in range(5)], "neuron_id long, point_no int, " + ", ".join(f"{c} double" for c in [*ends, "w0", "w1"]))
    moves = {"x0": F.col("x0") + 1, "z1": F.col("z1") * 2}
    assert sorted(rd.moved_cones(rows, moves).collect()) == sorted(rd.blended_cones(rows, rows.withColumns(moves)).collect())
