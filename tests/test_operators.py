"""Unit tests of the morphometry operators against hand-made goldens and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborkit.operators import clustering, density, geometry, matching, segments, stats, tree
from arborkit.sources.swc import read_swc, write_swc

TREE = [("n", i, float(i), 0.0, 0.0, 1.0, p) for i, p in ((1, -1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 3))]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(TREE, "neuron_id string, point_no int, x double, y double, z double, w double, parent int")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_classes_and_counts(points):
    kinds = dict(rows(tree.point_classes(points), "point_no", "kind"))
    assert kinds == {1: "root", 2: "slab", 3: "branch", 4: "slab", 5: "end", 6: "end"}
    assert rows(tree.tree_counts(points), "n_points", "n_edges", "n_trees") == [(6, 5, 1)]


def test_reroot_turns_only_the_path(points, spark):
    roots = spark.createDataFrame([("n", 6)], "neuron_id string, point_no int")
    assert dict(rows(tree.reroot(points, roots), "point_no", "parent")) == {1: 2, 2: 3, 3: 6, 4: 3, 5: 4, 6: -1}


def test_depths_and_orders(points):
    assert dict(rows(tree.depths(points), "point_no", "depth")) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 3}
    assert dict(rows(tree.branch_orders(points), "point_no", "branch_order"))[5] == 1


def test_edges_round_trip(points):
    single = tree.edges(points)
    double = tree.double_edges(single)
    assert double.count() == 10
    assert tree.single_edges(double).count() == 5


def sampled(p0, p1, q0, q1, n=60):
    t = np.linspace(0, 1, n)[:, None]
    a, b = p0 + t * (p1 - p0), q0 + t * (q1 - q0)
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min()


def test_segment_distance_against_sampling(spark):
    random.seed(3)
    data = [tuple(random.uniform(-1, 1) for _ in range(12)) for _ in range(60)]
    data += [(0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0), (0, 0, 0, 0, 0, 0, 3, 4, 0, 3, 4, 0), (0, 0, 0, 1, 0, 0, 2, 0, 0, 3, 0, 0)]
    names = [f"{t}{a}{e}" for t in "pq" for e in "01" for a in "xyz"]
    df = spark.createDataFrame([(i, *map(float, d)) for i, d in enumerate(data)], ["id", *names])
    got = {r.id: r.distance for r in geometry.with_segment_distance(df, names[:3], names[3:6], names[6:9], names[9:]).collect()}
    for i, d in enumerate(data):
        want = sampled(*np.array(d, dtype=float).reshape(4, 3))
        assert got[i] <= want + 1e-9 and want - got[i] < 0.05
    assert got[61] == 5 and got[62] == 1


def test_direct_synapses_equal_brute_force(spark):
    random.seed(5)
    def some(n):
        out = []
        for i in range(n):
            h = [random.uniform(0, 3) for _ in range(3)]
            out.append((i % 5, *h, *[x + random.uniform(-0.2, 0.2) for x in h]))
        return out

    a = some(60)
    df = spark.createDataFrame(a, ["neuron_id", *[c + e for e in "01" for c in "xyz"]])
    got = {(r.neuron_a, r.neuron_b): r.n for r in matching.direct_synapses(df, df, 0.3, 0.5).collect()}
    want = {}
    for p in a:
        for q in a:
            if p[0] < q[0] and all(abs(p[1 + k] - q[1 + k]) <= 1.6 for k in range(3)):
                d = np.array([*p[1:], *q[1:]]).reshape(4, 3)
                one = spark is None or sampled(*d, n=200)
                if one <= 0.3:
                    want[p[0], q[0]] = want.get((p[0], q[0]), 0) + 1
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_resample_keeps_ends(spark):
    line = spark.createDataFrame([("n", i, float(i), 0.0, 0.0) for i in range(4)], "neuron_id string, point_no int, x double, y double, z double")
    assert [round(x, 6) for (x,) in rows(segments.resample(line, 0.4), "x")] == [0, 0.4, 0.8, 1.2, 1.6, 2.0, 2.4, 2.8, 3.0]


def test_line_mismatch_of_equal_lines_is_zero(points):
    assert rows(segments.line_mismatch(points, points), "mismatch") == [(0.0,)]


def test_bin3d_drops_the_upper_bound(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 1.0, 0.5, 0.5), ("a", 0.9, 0.5, 0.5)], "d string, x double, y double, z double")
    grid = density.Grid((2, 2, 2), (0, 0, 0), (1, 1, 1))
    assert sum(v for (v,) in rows(density.bin3d(p, grid, ["d"]), "value")) == 2
    assert sum(v for (v,) in rows(density.bin3d(p, grid, ["d"], upper="include"), "value")) == 3


def test_smoothing_keeps_mass_away_from_edges(spark):
    grid = density.Grid((41, 41, 41), (0, 0, 0), (41, 41, 41))
    v = spark.createDataFrame([(20, 20, 20, 1.0)], "i int, j int, k int, value double")
    assert abs(density.gaussian_smooth(v, grid, 1.0).agg(F.sum("value")).first()[0] - 1) < 1e-6


def test_entropies_of_equal_volumes(spark):
    p = spark.createDataFrame([(1, float(i % 7), float(i % 7)) for i in range(70)], "pair int, a double, b double")
    out = stats.mutual_information(stats.entropies(p)).first()
    assert abs(out.nmi - 2) < 1e-9 and abs(out.mi - math.log(6)) < 1e-9 and abs(out.mi_distance) < 1e-9


def test_ward_separates_two_groups():
    x = np.array([0, 0.1, 0.2, 5, 5.1])
    merges = clustering.ward(np.abs(x[:, None] - x[None]))
    assert clustering.cut(merges, 5, 2).tolist() == [1, 1, 1, 2, 2]


def test_planes():
    assert geometry.plane_from_points([0, 0, 1], [1, 0, 1], [0, 1, 1]) == (0, 0, 1, -1)
    assert geometry.plane_from_point_and_normal([0, 0, 2], [0, 0, 1]) == (0, 0, 1, -2)
    m = geometry.rotation(30, 40, 50, degrees=True)
    assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3))


def test_swc_round_trip(spark, points, tmp_path):
    (tmp_path / "cell.swc").write_text("# comment\n1 2 0 0 0 1.5 -1\n 2 2 1 0 0 0.5 1\n\n")
    got = rows(read_swc(spark, str(tmp_path / "cell.swc")), "neuron_id", "point_no", "w", "parent")
    assert got == [("cell", 1, 3.0, -1), ("cell", 2, 1.0, 1)]
    write_swc(points.withColumn("label", F.lit(2)), str(tmp_path / "out"))
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 6


def test_swc_files_lie_in_one_folder_and_keep_every_name(spark, tmp_path):
    names = ["a/b", "_hidden", "0012", "x%20y", "50% +", "é .swc", None]
    made = spark.createDataFrame([(n, i, 2, float(i), 1.5, -2.0, 0.5, i - 1 if i > 1 else -1) for n in names for i in range(1, 4)], "neuron_id string, point_no int, label int, x double, y double, z double, w double, parent int")
    write_swc(made.repartition(5), str(tmp_path / "out"))
    assert sum(f.is_file() and f.suffix == ".swc" for f in (tmp_path / "out").iterdir()) == len(names)
    assert not [f for f in tmp_path.rglob("*") if f.name.endswith(".part") or f.is_dir() and f.parent != tmp_path]
    back = read_swc(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, made.select(back.columns).collect()))
    with pytest.raises(FileExistsError):
        write_swc(made, str(tmp_path / "out"))


def test_long_paths(spark):
    n = 150
    path = spark.createDataFrame([("n", i, i - 1 if i > 1 else -1) for i in range(1, n + 1)] + [("n", n + 1, 1), ("n", n + 3, n + 2)], "neuron_id string, point_no int, parent int")
    assert dict(rows(tree.depths(path), "point_no", "depth")) == {i: i - 1 for i in range(1, n + 1)} | {n + 1: 1}
    assert dict(rows(tree.branch_orders(path), "point_no", "branch_order")) == {1: 0} | {i: 1 for i in range(2, n + 2)}
    start = spark.createDataFrame([("n", n)], "neuron_id string, point_no int")
    assert rows(tree.path_to_root(path, start), "start", "step", "point_no") == [(n, i, n - i) for i in range(n)]
    assert dict(rows(tree.reroot(path, start), "point_no", "parent")) == {i: i + 1 for i in range(1, n)} | {n: -1, n + 1: 1, n + 3: n + 2}


def test_points_on_a_cycle_have_no_depth(spark):
    ring = spark.createDataFrame([("n", 1, -1), ("n", 2, 3), ("n", 3, 2), ("n", 4, 3)], "neuron_id string, point_no int, parent int")
    assert rows(tree.depths(ring), "point_no", "depth") == [(1, 0)]
    with pytest.raises(ValueError):
        tree.path_to_root(ring, spark.createDataFrame([("n", 4)], "neuron_id string, point_no int"))


def test_direct_synapses_query_finds_contacts_of_long_segments(spark, tmp_path):
    from arborkit.plans import volumes
    from arborkit.sources import adapters

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 120").write.parquet(str(tmp_path / "lineitem.parquet"))
    cols = [c + e for e in "01" for c in "xyz"]
    pieces = segments.seglets(adapters.points(spark, str(tmp_path))).select("neuron_id", *cols)
    pairs = pieces.select(F.col("neuron_id").alias("p"), *[F.col(c).alias("p" + c) for c in cols]).crossJoin(pieces.select(F.col("neuron_id").alias("q"), *[F.col(c).alias("q" + c) for c in cols])).where("p < q")
    far = geometry.with_segment_distance(pairs, *[[t + n + e for n in "xyz"] for t in "pq" for e in "01"])
    want = rows(far.groupBy("p", "q").agg(F.count_if(F.col("distance") <= 0.05).alias("n")).where("n > 0"), "p", "q", "n")
    assert len(want) > 20
    assert rows(volumes.direct_synapses(spark, str(tmp_path)), "neuron_a", "neuron_b", "n") == want


def test_gaussian_smooth_query_equals_a_brute_force_sum(spark):
    from arborkit.plans import volumes

    grid = volumes.GRID
    dense = {}
    for r in volumes.voxels(spark, "/root/testdata/sf0.001").collect():
        dense.setdefault(r.density_id, np.zeros(grid.n))[r.i, r.j, r.k] = r.value
    for axis, (n, d) in enumerate(zip(grid.n, grid.voxel)):
        o = np.arange(-40, 41)
        w = np.exp(-((o * d) ** 2) / (2 * 3.0**2))
        m = np.array([[w[a - b + 40] for b in range(n)] for a in range(n)]) / w.sum()
        dense = {k: np.moveaxis(np.tensordot(m, v, (1, axis)), 0, axis) for k, v in dense.items()}
    got = volumes.gaussian_smooth(spark, "/root/testdata/sf0.001").collect()
    assert got and max(abs(r.value - dense[r.density_id][r.i, r.j, r.k]) for r in got) < 1e-3
