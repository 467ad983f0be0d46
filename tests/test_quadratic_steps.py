"""Steps whose work grows with the square of a table: quicker and smaller forms give what the plain ones give."""

import numpy as np
from pyspark.sql import functions as F

from arborkit.operators import similarity as sim


def _points(rng, kind, n):
    if kind == 0:
        return rng.integers(0, 3, (n, 3)).astype(float)  # ties
    if kind == 1:
        return rng.integers(0, 30, (n, 3)) * 0.1  # ties but for rounding
    return rng.normal(size=(n, 3)) * (1e-3 if kind == 2 else 1e25) + (1e7 if kind == 2 else 0)  # beyond single precision


def test_nearest_of_few_is_exact():
    from arborkit.operators.neighbours import nearest_of_few, squares

    rng = np.random.default_rng(5)
    for trial in range(60):
        a, b = (_points(rng, trial % 4, int(n)) for n in (rng.integers(1, 65), rng.integers(1, 6000)))
        d = squares(a, b)
        at, d2 = nearest_of_few(b, a)
        assert (at == d.argmin(axis=0)).all() and (d2 == d.min(axis=0)).all()


def test_rounding_in_tasks_is_sparks(spark):
    rng = np.random.default_rng(6)
    v = np.r_[rng.normal(size=500) * 10 ** rng.uniform(-8, 12, 500), np.round(rng.normal(size=500), 6) + 5e-6, np.arange(-300, 300) / 2e5, np.inf, -0.0, 1e300, 5e-324]
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    found = [x.r for x in rows.select("i", (F.round("v", 5) + F.lit(0.0)).alias("r")).orderBy("i").collect()]
    got = sim.rounded(lambda x: (x, np.arange(3)), 5)(v)
    assert got[0].tolist() == found and not np.signbit(got[0][found.index(0.0)]) and got[1].tolist() == [0, 1, 2]


def test_nearest_both_ways_is_exact():
    rng = np.random.default_rng(7)
    for trial in range(40):
        n, m = (int(x) for x in rng.integers(1, 30, 2))
        a, *others = (_points(rng, trial % 4, k) for k in [int(rng.integers(1, 65)), *[m] * n])
        whole, starts, sizes = sim.stacked(others)
        d = [np.sqrt(((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2) + (a[:, None, 2] - b[None, :, 2]) ** 2) for b in others]
        one, back = sim._nearest_both_ways(a, np.asfortranarray(whole), n)
        assert one.tolist() == np.concatenate([x.min(axis=0) for x in d]).tolist() and back.tolist() == np.concatenate([x.min(axis=1) for x in d]).tolist()
        found = sim.median_distance(a, np.asfortranarray(whole), starts, sizes, both=True)[0]
        assert found.tolist() == [(np.median(x.min(axis=0)) + np.median(x.min(axis=1))) / 2 for x in d]


def test_contacts_are_those_of_all_pairs(monkeypatch):
    from arborkit.operators import matching as m

    rng = np.random.default_rng(8)
    monkeypatch.setattr(m, "TILE", (7, 20))
    monkeypatch.setattr(m, "HELD", 30)
    for trial in range(40):
        far, s = (0.0, 1e6)[trial % 2], (0.05, 0.5)[trial // 2 % 2]
        x = rng.integers(0, 5, (90, 6)).astype(float) if trial % 3 else rng.uniform(0, 5, (90, 6))  # touching, parallel and empty ones, or none such
        x[:5, 3:] = x[:5, :3]
        x += far
        if trial % 5 == 0:
            x[7], x[8, 2] = np.nan, np.inf
        of = np.sort(rng.integers(0, 30, 90))
        with np.errstate(invalid="ignore"):
            want = (np.sqrt(m.pair_squares(x.T[:, :, None], x.T[:, None, :])) <= s)[:60]
        found = [np.concatenate(c) for c in zip(*m.contacts(x[:60], x, s))]
        assert sorted(zip(*found)) == sorted(zip(*np.nonzero(want)))
        pairs = np.array([[want[of[:60] == i][:, of == j].sum() for j in range(30)] for i in range(30)])
        got = np.zeros((30, 30), dtype=int)
        for a, b, n in m._contacts_of_neurons(x[:60], x, of[:60], of, s):
            assert not got[a, b].any()
            got[a, b] = n
        assert (got == np.triu(pairs, 1)).all()


def test_expected_counts_of_neurons_of_any_size(monkeypatch):
    from arborkit.operators import matching as m

    rng = np.random.default_rng(9)
    monkeypatch.setattr(m, "TILE", (5, 8))
    x = rng.uniform(0, 3, (120, 6))
    x[3, 0] = np.nan
    of = np.sort(np.r_[np.full(60, 4), rng.integers(0, 25, 60)])
    u, mid = x[:, 3:] - x[:, :3], (x[:, 3:] + x[:, :3]) / 2
    length = np.sqrt((u**2).sum(axis=1))
    r2 = ((mid[:, None] - mid[None]) ** 2).sum(axis=2)
    term = length[:, None] * length * np.arccos(np.clip(u @ u.T / (length[:, None] * length), -1, 1)) * np.exp(-r2 / 0.5) * 3.0
    got = {}
    for a, b, n in m._expected_of_neurons(x, x, of, of, 1.0, 0.5, 3.0, 3):
        got |= {(int(i), int(j)): v for i, j, v in zip(a, b, n)}
    want = {(i, j): term[np.ix_(of == i, of == j)][hit].sum() for i in range(25) for j in range(i + 1, 25) if (hit := (r2 <= 1.0)[np.ix_(of == i, of == j)]).any()}
    assert got.keys() == want.keys() and len(want) > 50 and all(abs(got[k] - want[k]) < 5.1e-4 for k in want)


def test_segments_of_synapses_are_found_once(spark, monkeypatch):
    """The sets are counted, measured and met from a table of their own."""
    from arborkit.operators import matching as m

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i % 9, *map(float, p)) for i, p in enumerate(np.random.default_rng(4).uniform(0, 3, (40, 6)))]
    t = spark.createDataFrame(rows, "neuron_id long, " + ", ".join(f"{c} double" for c in m.SEG))
    for method, scale in (("direct", None), ("expected", 0.4)):
        made.value = 0
        segments = t.mapInArrow(seen, t.schema)
        assert m.potential_synapses(segments, segments, 0.3, method, scale).count() > 20 and made.value == 40


def test_blocks_of_segments_do_not_grow_in_number():
    """Each segment travels once a block; a block of any table fits a task."""
    from arborkit.operators import matching as m

    assert [m.dense_blocks(n) for n in (1, 540_000, 2_700_000, 10**8)] == [1, 24, 24, 100]


def test_lines_are_prepared_once_before_they_travel(spark):
    made = spark.sparkContext.accumulator(0)

    def half(xyz):
        made.add(1)
        return xyz[::2]

    rng = np.random.default_rng(3)
    clouds = spark.createDataFrame([(n, rng.normal(size=3 * m).tolist(), 3) for n, m in enumerate(rng.integers(0, 7, 40))], "neuron_id int, dots array<double>, width int")
    count = lambda a, others, starts, sizes: (sizes + len(a),)
    got = {(x.id_a, x.id_b): x.n for x in sim.pairwise(clouds, count, "n long", block=5, prepare=half).collect()}
    size = {x.neuron_id: (len(x.dots) // 3 + 1) // 2 for x in clouds.collect() if x.dots}
    assert made.value == len(size) and got == {(a, b): size[a] + size[b] for a in size for b in size if a < b}
    assert sim.blocks_of(360_000, 360_000 * 11, largest=4 * sim.LARGEST) == 44
