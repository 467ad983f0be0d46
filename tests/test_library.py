"""Segments, formats, registrations, similarity and volumes against published values and brute force."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborkit.functions import scalars as sc
from arborkit.operators import clustering, matching, registration, rendering, similarity, skeleton, tree
from arborkit.operators import geometry as g
from arborkit.operators import images as im
from arborkit.sources import formats as f
from arborkit.sources.files import decoded, encoded, files, write_files


# ------------------------------------------------------------------------- segments
def points_of(spark, parents, neuron="n"):
    rows = [(neuron, n, p, float(n), 1.0, 0.0, 1.0) for n, p in parents.items()]
    return spark.createDataFrame(rows, "neuron_id string, point_no int, parent int, x double, y double, z double, w double")


def segments_of(spark, parents, tree_no=None):
    found = {}
    for r in skeleton.segment_list(points_of(spark, parents)).orderBy("tree_no", "seg_no", "pos").collect():
        found.setdefault((r.tree_no, r.seg_no), []).append(r.point_no)
    return [v for (t, _), v in sorted(found.items()) if tree_no in (None, t)]


SIX = {1: -1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 3}


def test_segments_of_a_branching_tree(spark):
    assert segments_of(spark, SIX) == [[1, 2, 3], [3, 4, 5], [3, 6]]
    # labels with gaps, from another root
    assert segments_of(spark, {4: -1, 2: 4, 3: 4, 6: 3, 7: 6, 9: 6}) == [[4, 2], [4, 3, 6], [6, 7], [6, 9]]


def test_isolated_points_are_trees_and_the_largest_comes_first(spark):
    assert segments_of(spark, {1: -1, 5: -1, 6: 5, 7: 6, 10: -1}) == [[5, 6, 7], [1], [10]]
    sizes = {0: -1, 1: 0, 2: 1, 3: -1, 4: 3, 5: 4, 6: 5, 7: -1, 8: 7, 9: 8, 10: 9, 11: 10}
    assert segments_of(spark, sizes, 1) == [[7, 8, 9, 10, 11]]


def test_neuron_summary_and_reduced_graph(spark):
    points = points_of(spark, SIX)
    segments = skeleton.segment_list(points)
    row = skeleton.neuron_summary(points, segments).first()
    assert (row.start_point, row.branch_points, row.end_points, row.n_trees, row.n_segs) == (1, [3], [1, 5, 6], 1, 3)
    ends = {(r.src, r.dst) for r in skeleton.segment_ends(segments).collect()}
    assert ends == {(1, 3), (3, 5), (3, 6)}
    reduced = {(r.row, r.col) for r in skeleton.reduced_adjacency(tree.edges(points)).collect()}
    assert reduced == {(3, 6), (6, 3)}  # of 1, 3, 5 and 6 only 3 and 6 are neighbours
    with pytest.raises(ValueError):
        skeleton.graph(points.unionByName(points), tree.edges(points))


def test_paths_and_partition(spark):
    points = points_of(spark, {1: -1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 3, 7: 5, 8: 5, 9: 6, 10: 6})
    ends = spark.createDataFrame([("n", 8, 9)], "neuron_id string, src int, dst int")
    assert [r.point_no for r in skeleton.path_between(points, ends).orderBy("step").collect()] == [8, 5, 4, 3, 6, 9]
    segments = skeleton.segment_list(points)
    keys = spark.createDataFrame([("n", 5, [3, 5])], "neuron_id string, lh_branch_point int, mb_points array<int>")
    kinds = {r.seg_no: r.kind for r in skeleton.partition(segments, keys).collect()}
    # 1-3 and 3-5 axon, below 5 horn; 3-6 leaves the axon between the body points, with all below it
    assert kinds == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 3}


def test_segments_of_a_long_chain(spark):
    n = 1400
    rows = skeleton.segment_list(points_of(spark, {i: i - 1 if i > 1 else -1 for i in range(1, n + 1)}))
    assert rows.count() == n and rows.agg(F.max("pos")).first()[0] == n - 1


def test_resampled_tables_hang_together(spark):
    r = np.random.default_rng(1)
    rows = [("n", i, -1 if i == 1 else i - 1 if i % 7 else i // 2, *map(float, r.normal(size=3) * 5), 1.0) for i in range(1, 60)]
    points = spark.createDataFrame(rows, "neuron_id string, point_no int, parent int, x double, y double, z double, w double")
    new = skeleton.resample_segments(skeleton.segment_list(points), points, 1.5)
    got = {x.point_no: x for x in new.collect()}
    assert sorted(got) == list(range(1, len(got) + 1)) and [x.parent for x in got.values()].count(-1) == 1
    gaps = [math.dist((x.x, x.y, x.z), (got[x.parent].x, got[x.parent].y, got[x.parent].z)) for x in got.values() if x.parent != -1]
    assert max(gaps) <= 1.5 + 1e-9
    kinds = {x.kind for x in tree.point_classes(new.select("neuron_id", "point_no", "parent")).where("kind = 'branch'").collect()}
    before = tree.point_classes(points).where("kind = 'branch'").count()
    assert kinds == {"branch"} and tree.point_classes(new).where("kind = 'branch'").count() == before
    straight = points.withColumns({"x": F.col("point_no") * 1.0, "y": F.lit(0.0), "z": F.lit(0.0)})
    line = skeleton.spline_smooth(skeleton.segment_list(straight.where("point_no < 7")), straight.where("point_no < 7"))
    assert all(abs(x.y) < 1e-9 and abs(x.x - round(x.x)) < 1e-3 for x in line.collect())


def test_resampling_walks_a_neuron_once_and_keeps_places_without_values(spark):
    rows = [("n", i, p, x, 0.0, 0.0, 1.0) for i, p, x in [(1, -1, 0.0), (2, 1, 2.5), (3, 2, None), (4, 2, 2.5), (5, 4, 6.0), (9, -1, 1.0)]]
    points = spark.createDataFrame(rows, "neuron_id string, point_no int, parent int, x double, y double, z double, w double")
    new = skeleton.resample_segments(skeleton.segment_list(points), points, 1.0)
    assert new._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 2
    got = [(x.tree_no, x.seg_no, x.point_no, x.parent, x.s, x.x) for x in new.orderBy("point_no").collect()]
    first = [(1, 1, n + 1, n if n else -1, s, s) for n, s in enumerate((0.0, 1.0, 2.0, 2.5))]
    ahead = [(1, 3, n, p, s, 2.5 + s) for n, p, s in ((6, 4, 1.0), (7, 6, 2.0), (8, 7, 3.0), (9, 8, 3.5))]
    assert got == [*first, (1, 2, 5, 4, 0.0, None), *ahead, (2, 1, 10, -1, 0.0, 1.0)]


# ---------------------------------------------------------------------- registrations
#: Two published parameter sets and their matrices (by column).
PLAIN = [100, 50, 10, 3, 3, 3, 1.1, 0.9, 1, 0, 0, 0, 10, 50, 50]
SHEARED = [100, 50, 10, 3, 3, 3, 1.1, 0.9, 1, 0.03, 0.1, 0.05, 10, 50, 50]
PLAIN_MATRIX = [1.09698704245255, -0.0574906547972094, -0.0575695518672382, 0, 0.0494995771563172, 0.897405837085788, 0.0470378084704441, 0, 0.0494535530049303, -0.0549995301736858, 0.997260947684137, 0, 94.0824730674121, 58.454591202367, 8.36075771094335, 1]
SHEARED_MATRIX = [1.09698704245255, -0.0574906547972094, -0.0575695518672382, 0, 0.0794174055868413, 0.895837910136773, 0.0454677297831557, 0, 0.151929624282028, -0.0103700734989691, 0.994640563641534, 0, 87.462778082031, 56.3015147160819, 8.57028084743792, 1]


@pytest.mark.parametrize("params,matrix", [(PLAIN, PLAIN_MATRIX), (SHEARED, SHEARED_MATRIX)])
def test_affine_composition(params, matrix):
    m = registration.compose(params)
    assert np.allclose(m.T.ravel(), matrix, atol=1e-6)
    assert np.allclose(registration.decompose(m, params[12:]).ravel(), params, atol=1e-6)


def test_decomposition_of_a_mirror():
    p = registration.decompose(registration.compose(registration.flip(1, 50, 1.4)))
    assert np.allclose(registration.compose(p), registration.compose(registration.flip(1, 50, 1.4)))


def test_fits_with_outliers():
    r = np.random.default_rng(2)
    p = r.normal(size=(30, 3)) * 20
    m = registration.compose(SHEARED)
    q = p @ m[:3, :3].T + m[:3, 3]
    q[0] += 500
    assert np.abs(registration.least_absolute(p, q) - m).max() < 1e-4 < np.abs(registration.least_squares(p, q) - m).max()
    with pytest.raises(ValueError):
        registration.fit_params(p, q, 7)


# ----------------------------------------------------------------------------- formats
def test_malformed_files_are_errors():
    for read, data in ((f.read_typed_stream, b"x"), (f.read_mesh, b"# PLY"), (f.read_nrrd, b"GIF"), (f.read_raw_stack, b"y"), (f.read_vtk, b"# vtk DataFile Version 2.0\nt\nBINARY\nDATASET POLYDATA\nPOINTS 0 float\n"), (f.read_irtk_matrix, b"z\n"), (f.read_surface, b"w")):
        with pytest.raises(f.FormatError):
            read(data)
    with pytest.raises(f.FormatError):
        f.read_nrrd(f.write_nrrd(np.ones((3, 3)))[:-4])
    with pytest.raises(f.FormatError):
        f.nrrd_type("quaternion")
    assert not f.nrrd_checks(f.write_nrrd(np.ones((9, 9)), "float", "gzip")[:-20])["intact"]


def test_run_lengths_and_missing_values():
    body = bytes([5, 7, 128 + 3, 1, 2, 3])
    head = b"# AmiraMesh BINARY-LITTLE-ENDIAN 2.1\n\ndefine Lattice 2 2 2\n\nLattice { byte Labels } = @1(HxByteRLE,6)\n\n@1\n"
    assert f.section(f.read_mesh(head + body + b"\n"), "Labels").ravel().tolist() == [7] * 5 + [1, 2, 3]
    text = b"# AmiraMesh ASCII 1.0\n\ndefine Markers 2\n\nMarkers { float[3] Coordinates } = @1\n\n@1\n1 2 NA\n4 5 6\n"
    assert math.isnan(f.section(f.read_mesh(text), "Coordinates")[0, 2])


def test_nrrd_headers_are_edited_in_place():
    data = f.write_nrrd(np.arange(8.0).reshape(2, 2, 2), "float", "raw", [1, 2, 3], [4, 5, 6])
    fields = f.read_nrrd_header(f.edit_nrrd(f.edit_nrrd(data, {"axis mins": "0 0 0", "kinds": "x"}, "replaceonly"), {"axis mins": "9 9 9", "content": "c"}, "addonly"))[0]
    assert (fields["axismins"], fields["content"], "kinds" in fields) == ("0 0 0", "c", False)
    with pytest.raises(f.FormatError):
        f.edit_nrrd(data, {"colour": "red"})


def test_neuron_files_by_ending_and_by_beginning():
    asc = b'; V3\n( (Color Blue)\n  (Axon)\n  ( 1 2 3 0.5)  ; Root\n  ( 2 2 3 0.5)\n  (\n    ( 3 2 3 0.5)\n    Normal\n  |\n    ( 3 4 3 0.5)\n    (\n      ( 4 4 3 0.5)\n    |\n      ( 4 5 3 ERR)\n    )\n  )\n)\n("MB" (Color Red)\n' + b"".join(b" ( %d 0 1 0)\n" % i for i in range(6)) + b')\n("Marker"\n ( 7 7 7 0)\n)\n'
    points = f.neuron_reader("x", asc)(asc)
    assert [p[5] for p in points] == [-1, 1, 2, 2, 4, 4] and math.isnan(points[5][4])
    read = f.read_asc(asc)
    assert len(read["contours"]) == 6 and read["markers"] == [("Marker", 7.0, 7.0, 7.0)]
    with pytest.raises(f.FormatError):
        f.neuron_reader("x.png", b"\x89PNG")
    swc = b"# c\n1 2 0 0 0 1 -1\n2 2 1 0 0 NA 1\n"
    assert f.neuron_reader("a.swc", swc)(swc)[0][4] == 2.0
    xml = b'<tracings><path id="0"><point x="1" y="2" z="3" xd="1.5" yd="2" zd="3"/><point x="2" y="2" z="3" xd="2.5" yd="2" zd="3"/></path><path id="1" startson="0" startsindex="1"><point x="9" y="2" z="3" xd="9" yd="2" zd="3"/></path></tracings>'
    assert [p[4] for p in f.joined_traces(f.read_traces(xml))] == [-1, 1, 2]


def test_existing_files_stay_unless_forced(spark, tmp_path):
    table = spark.createDataFrame([("a/b.txt", b"one"), ("c.txt", b"two")], "name string, content binary")
    assert {r.written for r in write_files(table, str(tmp_path)).collect()} == {True}
    again = table.withColumn("content", F.lit(b"new"))
    assert {r.written for r in write_files(again, str(tmp_path)).collect()} == {False}
    assert {r.written for r in write_files(again.where("name = 'c.txt'"), str(tmp_path), force=True).collect()} == {True}
    assert {r.name: bytes(r.content) for r in files(spark, str(tmp_path)).collect()} == {"b.txt": b"one", "c.txt": b"new"}
    assert decoded(table.limit(0), lambda n, d: [(1,)], "x int").count() == 0
    assert encoded(table.limit(0), "name", [], [], lambda c: b"", "").count() == 0


def test_landmarks_beyond_a_hundred_sections(spark, tmp_path):
    from arborkit.sources.swc import read_landmarks

    sets = [[[float(i), 0.0, 1.0]] for i in range(120)]
    (tmp_path / "many.landmarkAscii").write_bytes(f.write_landmark_sets(sets))
    assert read_landmarks(spark, str(tmp_path)).where("x is not null").select("set_no").distinct().count() == 120


def test_look_up_tables_are_guessed():
    rgb = np.stack([np.arange(256), 255 - np.arange(256), np.arange(256) // 2], axis=1)
    nih = struct.pack(">i", f.LUT_MAGIC) + bytes(28) + rgb.T.astype(np.uint8).tobytes()
    for data in (nih, f.write_lut(rgb, text=False), f.write_lut(rgb), b"Index R G B\n" + b"".join(b"%d %d %d %d\n" % (i, *map(int, x)) for i, x in enumerate(rgb))):
        assert (f.read_lut(data) == rgb).all()
    with pytest.raises(ValueError):
        f.write_lut(rgb, 0, 100)


# -------------------------------------------------------------------------- similarity
def test_pairs_are_complete_over_many_blocks(spark):
    r = np.random.default_rng(3)
    rows = [(i, j, *map(float, r.normal(size=3))) for i in range(13) for j in range(4)]
    clouds = similarity.packed(spark.createDataFrame(rows, "neuron_id long, dot_id int, x double, y double, z double"))
    one, many = ({(x.id_a, x.id_b): x.d for x in similarity.pairwise(clouds, similarity.median_distance, "d double", both=True, block=b).collect()} for b in (100, 3))
    assert one == many and len(one) == 13 * 12
    assert similarity.pairwise(clouds.limit(0), similarity.median_distance, "d double").count() == 0


def test_alignment_of_a_line_with_itself():
    line = np.cumsum(np.random.default_rng(4).random((12, 3)), axis=0)
    assert similarity.aligned(line, line)[0] == 0 and similarity.chunks_matched(line, line, 0.5)[0] == 0
    assert similarity.chunks_matched(line, line[::-1], 0.5)[0] > 0
    assert similarity.polyline_mismatch(line, line + [1, 2, 3])[0] == pytest.approx(14 * np.sqrt((np.diff(line, axis=0) ** 2).sum(axis=1)).sum())


def test_tangents_of_a_line():
    t = np.linspace(0, 9, 40)[:, None] * np.array([[1.0, 2.0, 2.0]]) / 3
    v, alpha = similarity.tangents(t)
    assert np.allclose(np.abs(v), np.array([1, 2, 2]) / 3) and np.allclose(alpha, 1)


def test_segment_distance_by_sampling(spark):
    r = np.random.default_rng(5)
    s = r.normal(size=(150, 12))
    s[:20, 3:6] = s[:20, :3]  # points
    s[20:40, 9:] = s[20:40, 6:9] + (s[20:40, 3:6] - s[20:40, :3])  # parallels
    names = [f"{t}{a}{e}" for t in "pq" for e in "01" for a in "xyz"]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = {x.i: x.distance for x in g.with_segment_distance(df, *[names[k : k + 3] for k in (0, 3, 6, 9)]).collect()}
    u = np.linspace(0, 1, 401)
    for i, x in enumerate(s):
        a, b = x[:3] + u[:, None] * (x[3:6] - x[:3]), x[6:9] + u[:, None] * (x[9:] - x[6:9])
        best = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min()
        assert best - 0.02 < got[i] <= best + 1e-9


def test_ward_and_orders():
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(10, 2)) + c for c in ((0, 0), (20, 0), (0, 20))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    merges = clustering.ward(d)
    labels = clustering.ordered_cut(merges, 30, 3)
    assert [len(set(labels[i : i + 10])) for i in (0, 10, 20)] == [1, 1, 1] and sorted(set(labels)) == [1, 2, 3]
    assert (np.diff(merges[:, 2]) >= -1e-9).all() and merges[-1, 3] == 30
    walk = rendering.dendrogram(merges, 30)
    assert [w[1] for w in walk if w[1] < 30].__len__() == 30 and walk[0][5] == 30
    assert rendering.merged_labels(merges, list(labels))[-1] is None


def test_prefixes_ranks_and_numbers(spark):
    names = spark.createDataFrame([("Alpha",), ("Alpine",), ("beta",), ("Bet",), ("x" * 80 + "1",), ("x" * 80 + "2",)], "name string")
    keys = spark.createDataFrame([("al",), ("ALPH",), ("bet",), ("q",), ("x" * 80 + "2",), ("x" * 70,)], "key string")
    got = {r.key: r.matched for r in matching.prefix_match(keys, "key", names, "name").collect()}
    assert got == {"al": None, "ALPH": "Alpha", "bet": "Bet", "q": None, "x" * 80 + "2": "x" * 80 + "2", "x" * 70: None}
    numbered = matching.numbered(names.repartition(3), [F.col("name")]).orderBy("place").collect()
    assert [r.place for r in numbered] == list(range(6)) and [r.name for r in numbered] == sorted(r.name for r in numbered)


# ----------------------------------------------------------------------------- volumes
def test_error_function(spark):
    x = [i / 50 for i in range(-400, 401)]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", sc.erf(F.col("x")).alias("e"))
    assert max(abs(r.e - math.erf(r.x)) for r in df.collect()) < 1e-11


def test_grids_and_cubes_are_checked(spark):
    with pytest.raises(ValueError):
        im.grid_of([1, 2, 3])
    with pytest.raises(ValueError):
        im.as_cube(spark.range(10), "id", 10)
    assert [round(float(x), 9) for x in im.grid_of([10, 5, 2, 1.0, 2.0, 3.0]).low] == [-0.5, -1.0, -1.5]


def test_hull_of_random_points_holds_them_all(spark):
    r = np.random.default_rng(7)
    p = r.normal(size=(200, 3))
    h = im.convex_hull(p)
    n = np.cross(h[:, 1] - h[:, 0], h[:, 2] - h[:, 0])
    assert ((p[:, None] - h[None, :, 0]) * n[None]).sum(axis=2).max() < 1e-9
    inside = (r.random((200_000, 3)) - 0.5) * 8
    share = (((inside[:, None] - h[None, :, 0]) * n[None]).sum(axis=2) <= 0).all(axis=1).mean() if len(h) < 60 else None
    df = spark.createDataFrame([(1, *map(float, x)) for x in p] + [(2, float(i), 0.0, 0.0) for i in range(9)], "s int, x double, y double, z double")
    got = {x.s: x for x in im.hull_measures(df, "s").collect()}
    assert got[2].volume == 0 and got[1].volume > 0
    if share is not None:
        assert got[1].volume == pytest.approx(share * 512, rel=0.03)


def test_independent_components_are_found(spark):
    r = np.random.default_rng(8)
    s = np.stack([np.sign(r.normal(size=400)) * r.random(400) ** 3, r.random(400)])
    mixed = np.array([[1.0, 0.6], [0.4, 1.0]]) @ s
    rows = [(d, i % 20, i // 20, 0, float(mixed[k, i])) for k, d in enumerate("ab") for i in range(400)]
    unmix, scores = im.independent_components(spark.createDataFrame(rows, "density_id string, i int, j int, k int, value double"), "density_id", 2)
    found = np.abs(unmix @ np.array([[1.0, 0.6], [0.4, 1.0]]))
    found = found / found.max(axis=1, keepdims=True)
    assert np.sort(found, axis=1)[:, 0].max() < 0.15 and scores.count() == 800


def test_fit_of_a_normal_distribution():
    x = np.linspace(-3, 9, 60)
    share = np.array([0.5 * (1 + math.erf((v - 2.5) / (1.5 * math.sqrt(2)))) for v in x])
    assert im.fit_normal(x, share) == pytest.approx((2.5, 1.5), abs=1e-6)
