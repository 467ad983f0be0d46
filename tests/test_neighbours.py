"""Nearest points through trees and joins, pair scores by blocks and alignments by diagonals, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborkit.operators import neighbours, similarity


def table(query, target, k):
    d = ((query[:, None] - target[None]) ** 2).sum(axis=2)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    return at, np.sqrt(np.take_along_axis(d, at, axis=1))


@pytest.mark.parametrize(("n", "m", "k"), [(300, 300, 1), (100, 1000, 5), (30, 2000, 20), (10, 30, 3), (1, 1, 1), (20, 5, 9)])
def test_trees_give_the_same_places_as_a_table(n, m, k):
    r = np.random.default_rng(n)
    target, query = np.round(r.normal(size=(m, 3)), 1), np.round(2 * r.normal(size=(n, 3)), 1)  # many ties
    at, far = neighbours.nearest(query, target, k)
    want = table(query, target, k)
    assert np.array_equal(at, want[0]) and np.array_equal(far, want[1])


def test_trees_measure_few_distances():
    r = np.random.default_rng(0)
    points = r.normal(size=(20_000, 3))
    tree = neighbours.KdTree(points)
    at, far = tree.query(points, 20)
    assert (at[:, 0] == np.arange(len(points))).all() and (far[:, 0] == 0).all()
    assert tree.measured < 0.05 * len(points) ** 2
    tree.measured = 0
    tree.query(r.normal(size=(2000, 3)) + 50)
    assert tree.measured < 0.2 * 2000 * len(points)


def test_trees_of_equal_points():
    points = np.zeros((500, 3))
    at, far = neighbours.nearest(np.zeros((3, 3)), points, 4)
    assert (at == np.arange(4)).all() and (far == 0).all()
    assert neighbours.nearest(np.zeros((0, 3)), points)[0].shape == (0, 1)


@pytest.mark.parametrize("split", [False, True])
def test_join_of_clouds(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(neighbours, "TREE_POINTS", 70)
        monkeypatch.setattr(neighbours, "GROUP_QUERIES", 50)
    r = np.random.default_rng(3)
    clouds = {name: np.round(r.normal(size=(n, 3)), 1) for name, n in (("a", 200), ("b", 5), ("c", 90), ("d", 1))}
    rows = [(name, i, *map(float, p)) for name, c in clouds.items() for i, p in enumerate(c)] + [("a", 999, None, 0.0, 0.0), ("e", 0, None, None, None)]
    dots = spark.createDataFrame(rows, "neuron_id string, dot_id int, x double, y double, z double").repartition(3)
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("d", "a"), ("a", "a"), ("a", "e"), ("e", "a"), ("a", "missing")]
    got = neighbours.nearest_points(dots, dots, spark.createDataFrame([*pairs, pairs[0]], "query_id string, target_id string"))
    want = set()
    for q, t in pairs:
        if q in clouds and t in clouds:
            at, far = table(clouds[q], clouds[t], 1)
            want |= {(q, t, i, int(a), float(d)) for i, (a, d) in enumerate(zip(at[:, 0], far[:, 0]))}
    assert got.count() == len(want) and set(map(tuple, got.collect())) == want


def test_pair_scores_by_blocks_equal_each_pairs_own(spark):
    r = np.random.default_rng(4)
    clouds = {i: np.c_[r.normal(size=(n, 3)), r.normal(size=(n, 3))] for i, n in enumerate((5, 90, 7, 1, 130, 21, 21))}
    rows = [(i, j, *map(float, p)) for i, c in clouds.items() for j, p in enumerate(c)]
    dots = spark.createDataFrame(rows, "neuron_id long, dot_id int, x double, y double, z double, vx double, vy double, vz double")
    packed = similarity.packed(dots, columns=("x", "y", "z", "vx", "vy", "vz"))
    for block in (256, 2):
        got = {tuple(x[:2]): x[2:] for x in similarity.pairwise(packed, similarity.pair_scores, "d double, t double, s double, apart double, turned double", True, block).collect()}
        assert len(got) == 42
        for (a, b), found in got.items():
            at, far = table(clouds[b][:, :3], clouds[a][:, :3], 1)
            dot = np.abs((clouds[a][at[:, 0], 3:] * clouds[b][:, 3:]).sum(axis=1))
            g = np.exp(-(far[:, 0] ** 2) / 18)
            want = (1 - np.sqrt(g * dot).mean(), np.sqrt(g * dot).sum(), ((g - np.exp(-2)) / (1 - np.exp(-2)) * dot).sum(), 1 - g.mean(), 1 - dot.mean())
            assert np.allclose(found, want)
        both = {tuple(x[:2]): x[2] for x in similarity.pairwise(packed, lambda *x: similarity.median_distance(*x, both=True), "d double", block=block).collect()}
        assert len(both) == 21
        for (a, b), found in both.items():
            one, two = (np.median(table(clouds[p][:, :3], clouds[q][:, :3], 1)[1]) for p, q in ((a, b), (b, a)))
            assert np.isclose(found, (one + two) / 2)


def plain_alignment(a, b, k=10):
    at, d = table(a, b, k)
    cost = np.full((len(a), len(b)), d.max())
    cost[np.arange(len(a))[:, None], at] = d
    total, steps = np.full((len(a) + 1, len(b) + 1), np.inf), np.zeros((len(a) + 1, len(b) + 1), int)
    total[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            c = cost[i - 1, j - 1]
            ways = [(total[i - 1, j - 1] + (c if i == j == 1 else 2 * c), steps[i - 1, j - 1]), (total[i - 1, j] + c, steps[i - 1, j]), (total[i, j - 1] + c, steps[i, j - 1])]
            best = min(ways, key=lambda w: w[0])
            total[i, j], steps[i, j] = best[0], best[1] + 1
    return total[-1, -1] / (len(a) + len(b)), steps[-1, -1]


@pytest.mark.parametrize("cells", [300, 2_000_000])
def test_alignments_by_diagonals(monkeypatch, cells):
    monkeypatch.setattr(similarity, "CELLS", cells)
    r = np.random.default_rng(5)
    a, others = r.normal(size=(17, 3)), [r.normal(size=(n, 3)) for n in (1, 5, 40, 17, 30, 8, 2)]
    cost, steps = similarity.aligned_all(a, *similarity.stacked(others))
    want = [plain_alignment(a, b) for b in others]
    assert np.allclose(cost, [w[0] for w in want]) and steps.tolist() == [w[1] for w in want]


@pytest.mark.parametrize("skip", [False, True])
def test_step_strings_by_diagonals(skip):
    r = np.random.default_rng(6)
    u, others, delta = r.normal(size=(9, 3)), [r.normal(size=(n, 3)) for n in (1, 5, 12, 9)], 1.2
    cost, changed, put, out = similarity.chunks_matched_all(u, *similarity.stacked(others), delta=delta, skip_ends=skip)
    for n, v in enumerate(others):
        change, table_ = np.sqrt(((u[:, None] - v[None]) ** 2).sum(axis=2)), np.zeros((10, len(v) + 1))
        edge = 0 if skip else delta
        table_[:, 0], table_[0] = edge * np.arange(10), edge * np.arange(len(v) + 1)
        for i in range(1, 10):
            for j in range(1, len(v) + 1):
                table_[i, j] = min(table_[i - 1, j - 1] + change[i - 1, j - 1], table_[i - 1, j] + delta, table_[i, j - 1] + delta)
        assert np.isclose(cost[n], min(table_[9].min(), table_[:, -1].min()) if skip else table_[-1, -1])
        if not skip:
            assert changed[n] + out[n] == 9 and changed[n] + put[n] == len(v)


def test_alignments_with_ties_and_short_others():
    r = np.random.default_rng(7)
    a, others = r.integers(0, 3, (14, 3)).astype(float), [r.integers(0, 3, (n, 3)).astype(float) for n in (25, 11, 10, 3, 25, 18)]
    cost, steps = similarity.aligned_all(a, *similarity.stacked(others))
    want = [plain_alignment(a, b) for b in others]
    assert np.allclose(cost, [w[0] for w in want]) and steps.tolist() == [w[1] for w in want]


def test_mismatch_by_products_far_from_the_origin():
    r = np.random.default_rng(8)
    lines = [r.normal(size=(11, 3)) + 1e5 for _ in range(6)]
    lines[3][4] = lines[3][5]  # a step of no length
    rows = similarity._products(lines)
    for n, a in enumerate(lines):
        found = similarity._mismatch_by_products(rows[n], np.concatenate(rows), np.arange(6), np.ones(6, int))[0]
        want = [similarity.polyline_mismatch(a, b)[0] for b in lines]
        assert np.allclose(found, want, atol=1e-9) and (found >= 0).all()


def test_pairs_of_small_clouds_are_spread_over_tasks(spark):
    rows = [(i, j, float(i), float(j), 0.0) for i in range(40) for j in range(3)]
    packed = similarity.packed(spark.createDataFrame(rows, "neuron_id long, dot_id int, x double, y double, z double"))
    found = similarity.pairwise(packed, similarity.polyline_mismatch_all, "mismatch double", block=10)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(x["count"] for x in tasks) == 40 * 39 // 2
