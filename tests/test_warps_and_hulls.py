"""Curved warps, their derivatives and inverses; hulls, overlaps and outlines."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborkit.operators import images, registration

SPACING = (2.0, 3.0, 4.0)


def grid(spark, seed=0, size=0.4, n=(8, 7, 6), leave_out=()):
    r = np.random.default_rng(seed)
    rows = []
    for i, j, k in itertools.product(*map(range, n)):
        if (i, j, k) not in leave_out:
            rows.append((i, j, k, *(float((c - 1) * s + size * r.normal()) for c, s in zip((i, j, k), SPACING))))
    return spark.createDataFrame(rows, "i int, j int, k int, cx double, cy double, cz double")


def places(spark, n=200, seed=1):
    r = np.random.default_rng(seed)
    xyz = r.uniform(0.01, 1, size=(n, 3)) * [(c - 3) * s - 0.02 for c, s in zip((8, 7, 6), SPACING)]
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id int, x double, y double, z double")


def by_hand(control, point):
    """Sum over 64 control points, each weight from its polynomial."""
    pieces = [lambda u: (1 - u) ** 3 / 6, lambda u: (3 * u**3 - 6 * u**2 + 4) / 6, lambda u: (-3 * u**3 + 3 * u**2 + 3 * u + 1) / 6, lambda u: u**3 / 6]
    cell = [math.floor(c / s) for c, s in zip(point, SPACING)]
    u = [c / s - f for c, s, f in zip(point, SPACING, cell)]
    out = np.zeros(3)
    for o in itertools.product(range(4), repeat=3):
        key = tuple(f + d for f, d in zip(cell, o))
        if key not in control:
            return None
        out += math.prod(pieces[d](x) for d, x in zip(o, u)) * np.array(control[key])
    return out


def test_images_equal_a_sum_over_control_points(spark):
    controls = grid(spark, leave_out=[(7, 6, 5), (0, 0, 0)])
    control = {(r.i, r.j, r.k): (r.cx, r.cy, r.cz) for r in controls.collect()}
    asked = places(spark).unionByName(spark.createDataFrame([(900, -50.0, 1.0, 1.0), (901, None, 1.0, 1.0)], "id int, x double, y double, z double"))
    got = {r.id: r for r in registration.warp_points(asked, controls, SPACING).collect()}
    missing = 0
    for p in asked.collect():
        want = None if p.x is None else by_hand(control, (p.x, p.y, p.z))
        missing += want is None
        row = got[p.id]
        assert (row.from_x, row.from_y, row.from_z) == (p.x, p.y, p.z)
        assert row.x is None if want is None else np.allclose((row.x, row.y, row.z), want, atol=1e-12)
    assert missing > 2


def test_derivatives_equal_differences(spark):
    controls, asked, h = grid(spark), places(spark, 60).where("x > 0.1 and y > 0.1 and z > 0.1"), 1e-5
    jac = {r.id: r for r in registration.warp_jacobians(asked, controls, SPACING).collect()}
    for b in "xyz":
        ahead, behind = ({r.id: r for r in registration.warp_points(asked.withColumn(b, F.col(b) + d), controls, SPACING).collect()} for d in (h, -h))
        for i, row in jac.items():
            if ahead[i].x is None or behind[i].x is None:
                continue
            for a in "xyz":
                assert abs((ahead[i][a] - behind[i][a]) / (2 * h) - row[f"j{a}{b}"]) < 1e-6
    for row in jac.values():
        assert np.isclose(row.change, np.linalg.det([[row[f"j{a}{b}"] for b in "xyz"] for a in "xyz"]))


def test_inverse_of_a_curved_warp(spark):
    controls, asked = grid(spark), places(spark, 300, 2)
    moved = registration.warp_points(asked, controls, SPACING).select("id", "x", "y", "z")
    back = {r.id: r for r in registration.unwarp_points(moved, controls, SPACING).collect()}
    for p in asked.collect():
        assert np.allclose((back[p.id].x, back[p.id].y, back[p.id].z), (p.x, p.y, p.z), atol=1e-6)
    forward = registration.warp_points(registration.unwarp_points(asked, controls, SPACING).select("id", "x", "y", "z"), controls, SPACING)
    want = {p.id: p for p in asked.collect()}
    reached = [r for r in forward.collect() if r.x is not None]
    assert len(reached) > 200
    for r in reached:
        assert max(abs(r[a] - want[r.id][a]) for a in "xyz") < 1e-6


def test_tasks_that_hold_a_grid_and_joins_with_its_cells_agree(spark, monkeypatch):
    controls = grid(spark, leave_out=[(7, 6, 5), (3, 3, 0)])
    asked = places(spark, 300, 3).unionByName(spark.createDataFrame([(900, -50.0, 1.0, 1.0), (901, None, 1.0, 1.0), (902, math.nan, 1.0, 1.0), (903, math.inf, 1.0, 1.0)], "id int, x double, y double, z double"))

    def both():
        made = registration.warp_points(asked, controls, SPACING), registration.warp_jacobians(asked, controls, SPACING), registration.unwarp_points(asked, controls, SPACING)
        plans = [m._jdf.queryExecution().optimizedPlan().toString() for m in made]
        return ["Join" in p for p in plans[:2]], [{r.id: r for r in m.collect()} for m in made], [m.columns for m in made]

    held, few, columns = both()
    monkeypatch.setattr(registration, "HELD", 10)
    joined, want, wanted = both()
    assert held == [False, False] and joined == [True, True] and columns == wanted
    for a, b in zip(few, want):
        assert a.keys() == b.keys()
        for i in b:
            for x, y in zip(a[i], b[i]):
                assert (x is None) == (y is None) and (x is None or np.isclose(x, y, atol=1e-8, equal_nan=True))


def test_unreachable_points_and_empty_grids_give_nulls(spark):
    far = spark.createDataFrame([(1, 500.0, 0.0, 0.0), (2, None, 0.0, 0.0)], "id int, x double, y double, z double")
    rows = registration.unwarp_points(far, grid(spark), SPACING).collect()
    assert len(rows) == 2 and all(r.x is None and r.y is None and r.z is None for r in rows)
    assert sorted(r.from_x or 0 for r in rows) == [0, 500.0]
    none = grid(spark).where("i > 100")
    assert all(r.x is None for r in registration.unwarp_points(far, none, SPACING).collect())
    assert all(r.x is None for r in registration.warp_points(far, none, SPACING).collect())


def test_inverse_by_key(spark):
    m = np.array([[1.0, 2, 0, 5], [0, 1, 3, 6], [1, 0, 1, 7], [0, 0, 0, 1]])
    p = np.array([1.0, 2, 3])
    q = m[:3, :3] @ p + m[:3, 3]
    points = spark.createDataFrame([("a", *map(float, q)), ("flat", 1.0, 1.0, 1.0), ("none", 1.0, 1.0, 1.0)], "key string, x double, y double, z double")
    matrices = spark.createDataFrame([("a", m.ravel().tolist()), ("flat", [0.0] * 16)], "key string, matrix array<double>")
    got = {r.key: (r.x, r.y, r.z) for r in registration.invert_by(points, matrices, "key").collect()}
    assert np.allclose(got["a"], p) and got["flat"] == got["none"] == (None, None, None)


# ------------------------------------------------------------------------------ hulls
def cube(low, high):
    return [tuple(float(v) for v in p) for p in itertools.product(*zip(low, high))]


def sets(spark, named):
    return spark.createDataFrame([(k, i, *p) for k, ps in named.items() for i, p in enumerate(ps)], "s string, n int, x double, y double, z double")


def test_overlaps_of_boxes(spark):
    one = sets(spark, {"half": cube((0, 0, 0), (2, 1, 1)), "apart": cube((0, 0, 0), (1, 1, 1)), "flat": [(0.0, 0.0, 0.0)] * 3})
    two = sets(spark, {"half": cube((1, 0, 0), (3, 1, 1)), "apart": cube((4, 0, 0), (5, 1, 1)), "flat": [(1.0, 0.0, 0.0)]})
    got = {r.s: r for r in images.hull_overlap(one, two, "s").collect()}
    assert np.allclose((got["half"].overlap, got["half"].of_first, got["half"].of_both), (1, 0.5, 0.25))
    assert np.isclose(got["apart"].overlap, 2 - 5)
    assert got["flat"].overlap == 0 and got["flat"].of_first is None


def test_volumes_of_random_hulls_equal_facet_sums():
    for seed in range(5):
        p = np.random.default_rng(seed).normal(size=(15, 3))
        total = 0.0
        for a, b, c in itertools.combinations(range(15), 3):
            n = np.cross(p[b] - p[a], p[c] - p[a])
            side = np.delete((p - p[a]) @ n, [a, b, c])
            if (side > 0).all() or (side < 0).all():
                total += abs(n @ (p.mean(axis=0) - p[a])) / 6
        h = images.convex_hull(p)
        volume = abs((h[:, 0] * np.cross(h[:, 1] - h[:, 0], h[:, 2] - h[:, 0])).sum() / 6)
        assert np.isclose(volume, total)


@pytest.mark.parametrize("n", [4, 5, 12, 24])
def test_few_points_have_the_hull_of_many(monkeypatch, n):
    measured = []
    p = np.random.default_rng(n).normal(size=(n, 3))
    for few in (24, 0):
        monkeypatch.setattr(images, "FEW", few)
        h = images.convex_hull(p)
        cross = np.cross(h[:, 1] - h[:, 0], h[:, 2] - h[:, 0])
        outward = (cross * (h[:, 0] - p.mean(axis=0))).sum(axis=1)
        assert (outward > 0).all() and len(h) == 2 * len(np.unique(h.reshape(-1, 3), axis=0)) - 4
        measured.append((outward.sum() / 6, np.linalg.norm(cross, axis=1).sum() / 2, len(h)))
    assert np.allclose(measured[0], measured[1])
    flat = np.c_[p[:, :2], np.zeros(n)]
    monkeypatch.setattr(images, "FEW", 24)
    assert len(images.convex_hull(flat)) == 0 and len(images.convex_hull(np.array(cube((0, 0, 0), (1, 1, 1))))) == 12


@pytest.mark.parametrize(
    ("xy", "want"),
    [([(0, 0), (1, 0), (2, 0), (2, 2), (1, 1), (0, 2)], [0, 2, 3, 5]), ([(0, 0), (1, 1), (2, 2)], [0, 2]), ([(1, 1), (1, 1)], [0]), ([], [])],
)
def test_flat_hulls(xy, want):
    assert images.hull_2d(np.array(xy, dtype=float).reshape(-1, 2)).tolist() == want


def test_outlines_keep_order_and_drop_short_contours(spark):
    square = [(0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (1.0, 0.5, 1.0), (2.0, 2.0, 1.0), (0.0, 2.0, 1.0)]
    points = sets(spark, {"a": square, "b": square[:2]}).unionByName(spark.createDataFrame([("a", 99, None, 0.0, 0.0)], "s string, n int, x double, y double, z double"))
    got = images.outlines(points, ["s"], "n").orderBy("place").collect()
    assert [(r.s, r.n, r.place) for r in got] == [("a", 0, 1), ("a", 1, 2), ("a", 3, 3), ("a", 4, 4)]


def test_corner_volumes_before_and_after_in_one_pass(spark):
    from arborkit.operators import registration as reg

    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 3.0, 1.0, 2.0)], "neuron_id long, point_no int, x double, y double, z double")
    corners = reg.tetrahedra(points, 0.5)
    moved = corners.selectExpr("*", "x AS from_x", "y AS from_y", "z AS from_z").selectExpr("neuron_id", "point_no", "corner", "from_x", "from_y", "from_z", "2 * x AS x", "CASE WHEN point_no = 1 THEN y END AS y", "z")
    found = {r.point_no: (r.volume, r.before) for r in reg.corner_volume(moved, ["neuron_id", "point_no"], before=True).collect()}
    plain = 0.5**3 / (6 * 2**0.5)
    assert found[1] == pytest.approx((2 * plain, plain)) and found[2][0] is None and found[2][1] == pytest.approx(plain)
