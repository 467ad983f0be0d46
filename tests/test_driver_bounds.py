"""Components, permutations and clusterings that hold small matrices on the driver, against whole computations."""

import itertools

import numpy as np
import pytest

from arborkit.operators import clustering, images, matching


def test_mixed_signals_are_recovered(spark):
    r = np.random.default_rng(0)
    n = 1500
    signals = np.stack([np.sign(np.sin(np.arange(n) / 7)), r.uniform(-1, 1, n), r.laplace(size=n)])
    mix = np.array([[1.0, 0.4, 0.2], [0.3, 1.0, -0.5], [-0.2, 0.6, 1.0], [0.5, 0.5, 0.5]])
    volumes = mix @ signals + 3
    rows = [(f"v{v}", i % 15, i // 15 % 10, i // 150, float(volumes[v, i])) for v in range(4) for i in range(n)]
    voxels = spark.createDataFrame(rows, "name string, i int, j int, k int, value double").repartition(5)
    unmix, found = images.independent_components(voxels, "name", 3)
    assert unmix.shape == (3, 4) and found.count() == 3 * n
    got = np.zeros((3, n))
    for x in found.collect():
        got[x.component, x.i + 15 * x.j + 150 * x.k] = x.value
    match = np.abs(np.corrcoef(np.r_[signals, got])[:3, 3:])
    assert (match.max(axis=1) > 0.98).all() and len(set(match.argmax(axis=1).tolist())) == 3


def test_absent_voxels_count_as_zero(spark):
    r = np.random.default_rng(1)
    rows = [(n, i, j, 0, float(r.exponential())) for n in ("a", "b") for i in range(20) for j in range(10) if r.random() < 0.7]
    unmix, found = images.independent_components(spark.createDataFrame(rows, "name string, i int, j int, k int, value double"), "name", 2)
    held = {(x[1], x[2]) for x in rows}
    assert found.count() == 2 * len(held) and np.isfinite(unmix).all()


def table_of(spark, matrix, names=None):
    n = len(matrix)
    names = names or list(range(n))
    rows = [(names[i], names[j], float(matrix[i, j])) for i, j in itertools.combinations(range(n), 2)]
    return spark.createDataFrame(rows, f"a {'string' if isinstance(names[0], str) else 'long'}, b {'string' if isinstance(names[0], str) else 'long'}, d double").repartition(3)


def random_matrix(seed, n):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))


def test_permutations_in_one_plan(spark):
    one, two = table_of(spark, random_matrix(1, 12)), table_of(spark, random_matrix(2, 12))
    found = {x.permutation: x for x in matching.permuted_correlations(one, two, 30, 5).collect()}
    assert set(found) == set(range(31)) and all(x.n == 66 for x in found.values())
    m1, m2 = random_matrix(1, 12), random_matrix(2, 12)
    upper = np.triu_indices(12, 1)
    assert np.isclose(found[0].r, np.corrcoef(m1[upper], m2[upper])[0, 1])
    names = {}
    for x in matching.permuted_names(two, 30, 5).collect():
        names.setdefault(x.permutation, {})[x.old] = x.new
    for p, new in names.items():
        assert sorted(new) == sorted(new.values()) == list(range(12))
        back = {v: k for k, v in new.items()}
        other = np.array([[m2[back[i], back[j]] for j in range(12)] for i in range(12)])
        assert np.isclose(found[p].r, np.corrcoef(m1[upper], other[upper])[0, 1])
    assert len({tuple(sorted(x.items())) for x in names.values()}) > 25
    r, p = matching.mantel(one, two, 30, 5).first()
    assert np.isclose(r, found[0].r) and np.isclose(p, (1 + sum(found[i].r >= found[0].r for i in range(1, 31))) / 31)
    assert matching.mantel(one, two, 0, 5).first().p == 1.0
    single = matching.randomise(two, 6)  # the renaming of one seed alone is that of its permutation
    assert {(min(names[2][a], names[2][b]), max(names[2][a], names[2][b]), d) for a, b, d in two.collect()} == {tuple(x) for x in single.collect()}


def plain_merges(matrix, method):
    """Sets that merge, in order, by looking at all pairs of clusters."""
    groups, out = [frozenset([i]) for i in range(len(matrix))], []
    while len(groups) > 1:
        def apart(pair):
            d = [matrix[i, j] for i in pair[0] for j in pair[1]]
            if method == "ward":
                within = lambda g: sum(matrix[i, j] ** 2 for i in g for j in g) / (2 * len(g))
                return np.sqrt(2 * (within(pair[0] | pair[1]) - within(pair[0]) - within(pair[1])))
            return {"complete": max, "single": min, "average": np.mean}[method](d)

        pair = min(itertools.combinations(groups, 2), key=apart)
        out.append((pair[0] | pair[1], apart(pair)))
        groups = [g for g in groups if g not in pair] + [pair[0] | pair[1]]
    return out


@pytest.mark.parametrize("method", ["ward", "complete", "single", "average"])
def test_merges_of_condensed_distances(method):
    matrix = random_matrix(3, 14)
    merges = clustering.merged(clustering.Condensed.of(matrix), method)
    members, got = {i: frozenset([i]) for i in range(14)}, []
    for step, (a, b, height, size) in enumerate(merges):
        members[14 + step] = members[int(a)] | members[int(b)]
        assert len(members[14 + step]) == size
        got.append((members[14 + step], height))
    want = plain_merges(matrix, method)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_condensed_table(spark, monkeypatch):
    monkeypatch.setattr(clustering, "PIECE", 10)
    matrix, names = random_matrix(4, 15), [f"n{i:02}" for i in range(15)]
    found, d = clustering.condensed(table_of(spark, matrix, names))
    assert found == names and len(d.values) == 15 * 14 // 2
    for i in range(15):
        for j in range(15):
            assert i == j or d.values[d.place(i, j)] == matrix[i, j] == d.values[d.places(i)[j]]
    monkeypatch.setattr(clustering, "MOST_ITEMS", 14)
    with pytest.raises(ValueError, match="more than"):
        clustering.condensed(table_of(spark, matrix, names))


def test_leaves_lighter_branch_first():
    merges = np.array([(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 3.0, 4)])
    assert clustering.leaf_order(merges, 4) == [0, 1, 2, 3]
    assert clustering.leaf_order(merges, 4, np.array([9.0, 1.0, 2.0, 3.0])) == [2, 3, 1, 0]


def test_heat_map(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(7, 4)) + np.arange(7)[:, None] % 3
    cells = spark.createDataFrame([(f"r{i}", j, float(x[i, j])) for i in range(7) for j in range(4)], "row string, col int, value double")
    got = {(c.row, c.col): c for c in clustering.heat_map(cells, "row", "col", "value").collect()}
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    order = clustering.leaf_order(clustering.merged(clustering.Condensed.of(apart), "complete"), 7, x.mean(axis=1))
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
    for i in range(7):
        for j in range(4):
            c = got[f"r{i}", j]
            assert c.row_place == order.index(i) + 1 and np.isclose(c.value, z[i, j])
    lone = spark.createDataFrame([("a", 1, 2.0)], "row string, col int, value double")
    assert [(c.row_place, c.col_place, c.value) for c in clustering.heat_map(lone, "row", "col", "value").collect()] == [(1, 1, None)]
