"""What only larger tables bring: ties of decimals, counts beyond a file's type, sets and groups of many parts."""

import hashlib

import numpy as np
import pytest

from arborkit.operators import rendering as rd
from arborkit.sources import formats as f


def test_digests_round_exact_values(spark):
    rows = [(1, 0, 0.0078125, 0.5, float("inf")), (1, 1, None, 1.0, 1.0), (2, 0, None, None, None)]
    got = {r.neuron_id: (r.digest, r.n) for r in rd.digests(spark.createDataFrame(rows, "neuron_id long, dot_id int, x double, y double, z double")).collect()}
    assert got == {1: (hashlib.md5(b"0.007812,0.500000,inf").hexdigest(), 2), 2: (None, 1)}


def test_volumes_keep_counts_beyond_a_type():
    v = np.array([[[0.0, 255.0], [256.0, 70_000.0]]])
    assert f.read_raw_stack(f.write_raw_stack(v, 1)).ravel(order="F").tolist() == v.ravel(order="F").tolist()
    assert [f.write_raw_stack(v[:, :1] + x, 1)[25:27] for x in (0, 1)] == [b"\x01\0", b"\x02\0"]
    assert [f.kind_holding(x, "ushort") for x in (v, v[:, :1], v + 0.5, v * 1e6)] == ["int", "ushort", "double", "double"]
    with pytest.raises(f.FormatError):
        f.write_raw_stack(v + 2**24 + 1, 1)


def test_files_in_parts_are_the_whole_files(spark):
    """Parts joined are what the writers of whole files give, however few rows a part holds."""
    from arborkit.plans import files as plans
    from arborkit.sources.files import decoded_parts, encoded_parts, lines, scratch, write_parts

    points = [(n, n / 4, -1.0 * n, 0.5) for n in range(1, 32)]
    rows = spark.createDataFrame([("s", *p) for p in points], "set_id string, marker_no int, x double, y double, z double")
    places, faces = [p[1:] for p in points], [[i, i + 1, i + 2] for i in range(0, 30, 3)]
    put = lambda c: plans._places(plans._rows(c, plans.SPOT))

    def corners(shift):
        def write(c):
            first = c["marker_no"][0] - shift
            return f.lines_of([[3] * shift + [first + i + j for j in range(3)] for i in range(0, len(c["x"]) // 3 * 3, 3)]).encode()

        return write

    for whole, heads, more in (
        (f.write_vtk(places, kind="double"), f.vtk_sections("double"), []),
        (f.write_landmark_sets([places]), f.landmark_sections(), [None]),
        (f.write_vtk(places, faces), f.vtk_sections(faces=True), [corners(1), None]),
        (f.write_surface(places, faces, "inner"), f.surface_sections("inner"), [corners(0), None]),
    ):
        parts = encoded_parts(rows, "set_id", "marker_no", plans.SPOT, list(zip(heads, [put, *more])), ".x", size=6)
        found = parts.orderBy("section", "part").collect()
        assert b"".join(bytes(p.content) for p in found) == whole and max(len(p.content) for p in found if p.part) < 200
        folder = scratch(spark, "parts")
        assert [tuple(x) for x in write_parts(parts, folder).collect()] == [("s.x", True)]
        assert [tuple(x) for x in write_parts(parts, folder).collect()] == [("s.x", False)]
        read = [x.value for x in lines(spark, folder).orderBy("row").collect()]
        assert read == whole.decode().removesuffix("\n").split("\n")
        back = decoded_parts(parts, lambda section, part, start, data: plans._placed(start, data) if part and not section else [], "n int, x double, y double, z double")
        assert sorted(tuple(x)[1:] for x in back.collect()) == points


def test_numbers_within_keys_of_many_partitions(spark):
    from arborkit.operators.matching import numbered_within

    rows = spark.range(3000).selectExpr("if(id % 3 = 2, null, id % 3) as k", "2999 - id as v").repartition(5)
    got = numbered_within(rows, "k", ["v"], "n").collect()
    for k in (0, 1, None):
        own = sorted((x.v, x.n) for x in got if x.k == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1)) and len(own) == 1000


def test_crowded_segments_meet_in_blocks(spark, monkeypatch):
    """Blocks give what the grid gives, whole, for segments of several a neuron."""
    from arborkit.operators import matching as m

    rng = np.random.default_rng(4)
    rows = [(int(i % 17), *map(float, p)) for i, p in enumerate(rng.uniform(0, 3, (60, 6)))]
    rows += [(3, *[1.0] * 6), (4, *[1.0] * 6), (5, 1.0, 1.0, 1.0, 2.0, 1.0, 1.0), (6, None, *[1.0] * 5)]
    t = spark.createDataFrame(rows, "neuron_id long, " + ", ".join(f"{c} double" for c in m.SEG))
    for method, s, scale in (("direct", 0.3, None), ("expected", 0.5, 0.4)):
        got = {}
        for pruned in (0, 10**9):  # never, always
            monkeypatch.setattr(m, "PRUNED", pruned)
            monkeypatch.setattr(m, "BLOCK_SEGMENTS", 20)
            out = m.potential_synapses(t, t, s, method, scale)
            assert ("FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()) == bool(pruned)
            got[pruned] = {(r[0], r[1]): r[2] for r in out.collect()}
        one, two = got.values()
        assert one.keys() == two.keys() and len(one) > 50 and all(abs(one[k] - two[k]) < 1e-9 * max(1, abs(one[k])) for k in one)


def test_pairs_travel_by_blocks_that_do_not_grow_in_number(spark, monkeypatch):
    """Clouds are copied at most once a block; all pairs are given, in batches, whatever the blocks."""
    from arborkit.operators import similarity as sim

    rows = [(c, d, float(c), float(d), 1.0) for c in range(40) for d in range(3)]
    packed = sim.packed(spark.createDataFrame(rows, "neuron_id int, dot_id int, x double, y double, z double"))
    monkeypatch.setattr(sim, "PAIRS", 7)
    met = sim.pairwise(packed, sim.median_distance, "d double", block=1)
    assert sorted(tuple(r) for r in met.collect()) == [(a, b, float(b - a)) for a in range(40) for b in range(a + 1, 40)]
    assert [sim.blocks_of(n, n * 21) for n in (1, 2000, 12_000, 51_282)] == [1, 8, 16, 26] and sim.blocks_of(10, 4_000_000) == 10
    both = sim.pairwise(packed, sim.median_distance, "d double", both=True, block=3)
    assert both.count() == 40 * 39


def test_segments_of_a_neuron_share_a_call(spark):
    """One group a neuron, not one a segment; each segment is smoothed by itself."""
    import re

    from arborkit.operators import skeleton as k

    points = spark.createDataFrame([(n, p, p - 1 if p > 1 and p != 7 else (3 if p == 7 else -1), float(p), float(p * p % 5), float(n)) for n in (1, 2) for p in range(1, 12)], "neuron_id long, point_no int, parent int, x double, y double, z double")
    segments = k.segment_list(points)
    for smooth in (k.spline_smooth, k.bspline_smooth):
        out = smooth(segments, points)
        assert re.search(r"FlatMapGroupsInArrow \[neuron_id#\d+L?\], run", out._jdf.queryExecution().optimizedPlan().toString())
        got = {n: sorted(tuple(r)[1:] for r in out.collect() if r.neuron_id == n) for n in (1, 2)}
        assert [r[:4] for r in got[1]] == [r[:4] for r in got[2]] and len(got[1]) == segments.where("neuron_id = 1").count()
        alone = smooth(segments.where("neuron_id = 1 and seg_no = 3"), points).collect()
        assert sorted(tuple(r)[1:] for r in alone) == [r for r in got[1] if r[1] == 3] and len(alone) == 6


def test_columns_as_lists():
    import pyarrow as pa

    from arborkit.sources.files import lists

    t = pa.table({"a": pa.array([1, 2], pa.int32()), "b": [0.5, float("inf")], "c": pa.array([1, None], pa.int64()), "d": ["x", None], "e": [True, False], "f": [[1, 2], None]})
    got = lists(t, t.column_names)
    assert got == {c: t.column(c).to_pylist() for c in t.column_names} and type(got["a"][0]) is int and type(got["b"][0]) is float


def test_distances_of_a_clustering_are_found_once(spark):
    from arborkit.operators import clustering

    met = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    rows = [(f"n{a}", f"n{b}", float(b * b - a)) for a in range(9) for b in range(a + 1, 9)] + [("n0", "n9", None)]
    names, d = clustering.condensed(spark.createDataFrame(rows, "a string, b string, d double").repartition(3).mapInArrow(run, "a string, b string, d double"))
    assert met.value == len(rows) and names == [f"n{i}" for i in range(10)]
    assert d.values[d.place(2, 7)] == 47.0 and d.values[d.place(0, 9)] == float("inf")


def test_clouds_that_meet_one_stand_in_one_run(spark):
    """A cloud's others are a view of its block, axis by axis, not gathered cloud by cloud; kernels keep their results."""
    from arborkit.operators import neighbours as nb
    from arborkit.operators import similarity as sim

    rows = [(c * 7 % 40, d, float(c * 7 % 40), float(d), 1.0) for c in range(40) for d in range(3)]
    packed = sim.packed(spark.createDataFrame(rows, "neuron_id int, dot_id int, x double, y double, z double"))

    def seen(a, others, starts, sizes):
        return np.full(len(sizes), others.flags.owndata or not others[:, 0].flags.c_contiguous).astype(int), others[starts, 0] - a[0, 0]

    for both in (False, True):
        got = sim.pairwise(packed, seen, "copied int, apart double", both=both, block=9).collect()
        assert not any(r.copied for r in got) and all(r.apart == r.id_b - r.id_a for r in got) and len({(r.id_a, r.id_b) for r in got}) == len(got) == 780 * (1 + both)
    rng = np.random.default_rng(2)
    a, others = rng.integers(0, 4, (21, 3)).astype(float), rng.integers(0, 4, (9000, 3)).astype(float)
    d = np.sqrt(nb.squares(others, a))
    at, far = nb.nearest(others, a)
    assert (at[:, 0] == d.argmin(axis=1)).all() and (far[:, 0] == d.min(axis=1)).all() and (nb.least_distances(others, a) == d.min(axis=1)).all()
    for sizes in (np.full(3000, 3), np.tile([2, 4, 3], 1000)):
        starts = np.cumsum(sizes) - sizes
        want = [np.median(x) for x in np.split(d.min(axis=1), starts[1:])]
        back = [np.median(np.sqrt(nb.squares(a, x).min(axis=1))) for x in np.split(others, starts[1:])]
        assert np.array_equal(sim.median_distance(a, others, starts, sizes)[0], want)
        assert np.allclose(sim.median_distance(a, others, starts, sizes, both=True)[0], (np.array(want) + back) / 2, rtol=0, atol=1e-15)


def test_tangents_of_a_cloud_in_boxes_are_those_of_the_whole(spark):
    """Boxes of a few points give the same nearest, ties too, as one task that holds the cloud."""
    from arborkit.operators import large_clouds
    from arborkit.operators import similarity as sim

    rng = np.random.default_rng(7)
    rows = [("big", i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(rng.integers(0, 9, 1500), rng.integers(0, 60, 1500), rng.normal(size=1500)))]
    rows += [("ties", i, float(i % 3), float(i // 3 % 4), 1.0) for i in range(400)] + [("few", i, float(i), float(i * i), 0.5) for i in range(3)]
    rows += [("same", i, 1.0, 2.0, 3.0) for i in range(200)] + [("few", 9, None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "neuron_id string, point_no int, x double, y double, z double").repartition(5)
    kept = lambda df: sorted((r.neuron_id, r.dot_id, r.x, r.y, r.z, round(r.alpha, 9)) for r in df.collect())
    for k in (5, 20):
        boxed = large_clouds.dot_properties(points, k, size=40)
        assert kept(boxed) == kept(sim.dot_properties(points, k))
    assert len(large_clouds.boxes_of(np.array([r[2:] for r in rows[:1500]]), 1500, 40)[1]) > 30


def test_expected_synapses_shuffle_segments_not_pairs(spark, monkeypatch):
    """Where a grid is of use, segments meet over it within blocks: each pair once, summed where it is found."""
    from arborkit.operators import matching as m

    rng = np.random.default_rng(5)
    rows = [(int(i % 23), *map(float, np.r_[p, p + q])) for i, (p, q) in enumerate(zip(rng.uniform(0, 30, (700, 3)), rng.uniform(-1, 1, (700, 3))))]
    rows += [(3, *[1.0] * 6), (6, None, *[1.0] * 5), (7, *rows[0][1:])]
    t = spark.createDataFrame(rows, "neuron_id long, " + ", ".join(f"{c} double" for c in m.SEG))
    monkeypatch.setattr(m, "GRID_SEGMENTS", 200)
    monkeypatch.setattr(m, "STEP_PAIRS", 50)
    wanted = {}
    whole = [r for r in rows if None not in r and r[1:4] != r[4:]]
    for a in whole:
        for b in whole:
            (p, q), (u, v) = (np.array(x[1:]).reshape(2, 3) for x in (a, b))
            r2 = (((p + q - u - v) / 2) ** 2).sum()
            if a[0] < b[0] and r2 <= 9:
                p, u = q - p, v - u
                size = np.sqrt((p @ p) * (u @ u))
                wanted[a[0], b[0]] = wanted.get((a[0], b[0]), 0) + 2 * 0.5 * size * np.arccos(np.clip(p @ u / size, -1, 1)) * np.exp(-r2 / 0.36) / (np.pi * 0.36) ** 1.5
    for other in (t, t.select("*")):  # the same table, and one like it
        out = m.potential_synapses(t, other, 0.5, "expected", 0.3)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r[0], r[1]): r[2] for r in out.collect()}
        assert got.keys() == wanted.keys() and len(got) > 100 and all(abs(got[k] - wanted[k]) < 1e-9 * max(1, wanted[k]) for k in got)


def test_points_are_not_shuffled_to_few_voxels(spark, monkeypatch):
    from arborkit.operators import density, images

    grid = density.Grid((3, 3, 3), (0.0, 0.0, 0.0), (3.0, 3.0, 3.0))
    voxels = spark.createDataFrame([(v, i, j, 1, float(i + 3 * j)) for v in "ab" for i in range(3) for j in range(3)], "name string, i int, j int, k int, value double")
    points = spark.createDataFrame([(n, 0.1 * n, 1.0, 1.5) for n in range(30)], "id int, x double, y double, z double")
    for method in ("linear", "constant"):
        made = [images.interpolated(points, voxels, grid, ["id"], ["name"], method)]
        monkeypatch.setattr(images, "HELD_CELLS", 0)
        made.append(images.interpolated(points, voxels, grid, ["id"], ["name"], method))
        monkeypatch.undo()
        hints = [m._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") for m in made]
        assert hints == [2, 1] and sorted(map(tuple, made[0].collect()), key=str) == sorted(map(tuple, made[1].collect()), key=str)


def test_edge_lists_are_sorted_not_hashed(spark):
    from arborkit.operators import tree

    single = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("a", 2, 3), ("a", 2, 3), ("b", 7, 9), ("b", 4, 5), ("b", 5, 6)], "neuron_id string, src int, dst int")
    double = tree.double_edges(single)
    assert sorted(map(tuple, double.collect())) == sorted({(k, *e) for k, a, b in map(tuple, single.collect()) for e in ((a, b), (b, a))})
    assert "Aggregate" not in double._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, tree.trees_in_edges(double).collect())) == [("a", 1), ("b", 2)]
