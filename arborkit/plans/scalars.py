"""Registered queries on scalar functions, choices by region or name, orientation and affine matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from arborkit.catalog import register
from arborkit.functions import scalars as sc
from arborkit.operators import geometry as g
from arborkit.operators import registration as reg
from arborkit.operators import regions as rg
from arborkit.operators import segments as s
from arborkit.operators import skeleton as k
from arborkit.sources.adapters import ARBORS_SQL, POINTS_SQL, arbors, neurons, points, table

from .files import LINKS, MOVES, REGS, _params, regs  # noqa: F401
from .morphometry import r
from .skeletons import WALK

WITH = f"WITH {POINTS_SQL}"
#: Simpson's rule for the integral of exp(-t^2) from 0 to x.
ERF = "2 / sqrt(pi()) * {x} / 600 * list_sum(list_transform(range(0, 201), lambda i: (CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(({x} * i / 200.0) ** 2))))"


@register("normal_distribution", f"WITH v AS (SELECT DISTINCT (floor(value * 4) - 200) / 50 AS x FROM events WHERE value IS NOT NULL) SELECT x, round({ERF.format(x='x')}, 6) AS erf, round(0.5 * (1 + {ERF.format(x='((x - 0.5) / (2 * sqrt(2)))')}), 6) AS p FROM v WHERE abs(x) < 4")
def normal_distribution(spark, sf_dir):
    v = table(spark, sf_dir, "events").where("value is not null").select(((F.floor(F.col("value") * 4) - 200) / 50).alias("x")).distinct().where("abs(x) < 4")
    return v.select("x", r(sc.erf(F.col("x")), 6).alias("erf"), r(sc.cumnorm(F.col("x"), 0.5, 2.0), 6).alias("p"))


@register("downsampling_sigma", "SELECT n_nationkey, CASE WHEN (n_nationkey * 0.05) ** 2 >= 0.25 THEN round(sqrt((n_nationkey * 0.05) ** 2 - 0.25) * 1.4, 6) END AS sigma FROM nation")
def downsampling_sigma(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", r(F.nanvl(sc.downsampling_sigma(F.col("n_nationkey") * 0.1, 0.5, 0.5, 1.4), F.lit(None).cast("double")), 6).alias("sigma"))


@register("vector_products", f"""{WITH} SELECT neuron_id, point_no, round(x0*x1 + y0*y1 + z0*z1, 7) AS dot, round(y0*z1 - z0*y1, 7) AS cx, round(z0*x1 - x0*z1, 7) AS cy, round(x0*y1 - y0*x1, 7) AS cz, round(sqrt(x0*x0 + y0*y0 + z0*z0), 6) AS norm FROM seglets""")
def vector_products(spark, sf_dir):
    a, b = ("x0", "y0", "z0"), ("x1", "y1", "z1")
    cross = g.cross_product(a, b)
    return s.seglets(points(spark, sf_dir)).select("neuron_id", "point_no", r(g.dot_product(a, b), 7).alias("dot"), *[r(c, 7).alias(n) for c, n in zip(cross, ("cx", "cy", "cz"))], r(g.norm(a), 6).alias("norm"))


@register("sine_between", f"{WITH}, t AS (SELECT neuron_id, point_no, (x0*x1 + y0*y1 + z0*z1) / (sqrt(x0*x0+y0*y0+z0*z0) * sqrt(x1*x1+y1*y1+z1*z1)) AS c FROM seglets) SELECT neuron_id, point_no, round(sqrt(1 - greatest(-1.0, least(1.0, c)) ** 2), 3) AS sine FROM t")
def sine_between(spark, sf_dir):
    a, b = ("x0", "y0", "z0"), ("x1", "y1", "z1")
    rows = s.seglets(points(spark, sf_dir))
    return rows.select("neuron_id", "point_no", r(sc.sin_theta(F.try_divide(g.dot_product(a, b), g.norm(a) * g.norm(b))), 3).alias("sine"))


@register("plogp", "WITH c AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1) SELECT event_type, round(p * ln(p), 8) AS plogp FROM c")
def plogp(spark, sf_dir):
    from arborkit.operators import stats

    e = table(spark, sf_dir, "events")
    total = e.agg(F.count("*").alias("n"))
    c = e.groupBy("event_type").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("event_type", (F.col("c") / F.col("n")).alias("p"))
    return c.select("event_type", r(stats.plogp("p"), 8).alias("plogp"))


_NAMES = list(sc.COLOURS)
_CASES = " ".join(f"WHEN {i} THEN '{','.join(map(str, sc.COLOURS[n]))}'" for i, n in enumerate(_NAMES, 1))


@register("colours", f"SELECT n_nationkey, CASE CASE WHEN n_nationkey - 2 < 1 THEN 15 ELSE n_nationkey - 2 END {_CASES} END AS rgb FROM nation")
def colours(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(sc.colour((F.col("n_nationkey") - 2).cast("string")), lambda x: x.cast("string")), ",").alias("rgb"))


FILE = "CASE p_partkey % 4 WHEN 0 THEN concat('raw_LF', p_partkey % 90 + 1, 'R', p_partkey % 4 + 1, '01_warp.nrrd') WHEN 1 THEN concat('/a/b.c/ab', p_partkey % 9 + 1, 'LLH.am') WHEN 2 THEN concat('/x/NP', p_partkey, 'MARCM01-RESIZED.nrrd') ELSE concat('plain', p_partkey, '02_x') END"
_X1 = f"regexp_replace({FILE}, '^[^_]*_([^_]*)_[^_]*$', '\\1')"
_X2 = f"regexp_replace(regexp_extract({_X1}, '([^/]*)/?$', 1), '^([^_]*?)[._].*$', '\\1')"
_X3 = f"regexp_replace(upper(regexp_replace({_X2}, '(?i)^([A-Z]{{2,3}}[1-9][0-9]{{0,2}}[RLTB]([1-4]|LH)).*$', '\\1')), '^(.*)0[1-3]$', '\\1')"
_X4 = f"regexp_replace(regexp_replace(regexp_replace({_X3}, '(?i)^([A-Z]{{2,3}}[1-9][0-9]{{0,2}}[RLTB])([1-4]|LH)?.*$', '\\1'), '^(.*)LH$', '\\1'), '^(.*?)-.*$', '\\1')"


@register("image_ids", f"SELECT p_partkey, {_X3} AS id, {_X4} AS brain FROM part")
def image_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(FILE).alias("file"))
    return rows.select("p_partkey", sc.image_id(F.col("file")).alias("id"), sc.brain_id(F.col("file")).alias("brain"))


@register("names_matching", "WITH a AS (SELECT 'found' AS how, n_name FROM nation WHERE regexp_matches(n_name, '1$')), b AS (SELECT 'dropped' AS how, n_name FROM nation WHERE NOT regexp_matches(n_name, '1$')) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 'none', n_name FROM nation")
def names_matching(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name")
    parts = [sc.matching(n, "n_name", p, keep).select(F.lit(how).alias("how"), "n_name") for how, p, keep in (("found", "1$", True), ("dropped", "1$", False), ("none", "^zzz", True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("positions_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def positions_in(spark, sf_dir):
    return sc.positions_in(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register("neurons_of_types", "SELECT o_orderkey AS neuron_id FROM orders WHERE upper(o_orderpriority) IN ('1-URGENT', '5-LOW')")
def neurons_of_types(spark, sf_dir):
    return sc.of_types(neurons(spark, sf_dir), ["1-urgent", "5-low"]).select("neuron_id")


@register("neuron_by_reference", "SELECT * FROM (SELECT 'number' AS how, n_nationkey AS neuron_id, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 6) UNION ALL SELECT 'name', n_nationkey, n_name FROM nation WHERE n_name = 'NATION_5'")
def neuron_by_reference(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("neuron_id"), F.col("n_name").alias("name"))
    parts = [rg.by_reference(n, ref).select(F.lit(how).alias("how"), "neuron_id", "name") for how, ref in (("number", 7), ("name", "nation_5"))]
    return parts[0].unionByName(parts[1])


@register("names_and_types", "SELECT l_orderkey AS neuron_id, any_value(o_orderpriority) AS cell_type, any_value(o_custkey) AS brain FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def names_and_types(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("neuron_id")).distinct()
    return rg.names_of(neurons(spark, sf_dir), refs)


@register("matching_neurons", f"""WITH {ARBORS_SQL}, c AS (SELECT neuron_id, parent AS point_no, count(*) AS n FROM arbors WHERE parent <> -1 GROUP BY ALL), p AS (SELECT a.*, c.n FROM arbors a LEFT JOIN c USING (neuron_id, point_no))
SELECT neuron_id, array_to_string(list_sort(list(point_no)), ',') AS points, count(*)::BIGINT AS n FROM p WHERE (n IS NULL OR parent = -1) AND x > 25 AND z < 5 GROUP BY neuron_id""")
def matching_neurons(spark, sf_dir):
    out = rg.matching_neurons(arbors(spark, sf_dir), (F.col("x") > 25) & (F.col("z") < 5))
    return out.withColumn("points", F.array_join(F.transform("points", lambda x: x.cast("string")), ","))


@register("points_of_long_segments", f"""{WALK}, b AS (SELECT neuron_id, seg_no FROM (SELECT neuron_id, seg_no, count(*) AS n FROM seg WHERE tree_no = 1 GROUP BY ALL) WHERE n > 8),
q AS (SELECT DISTINCT neuron_id, point_no FROM seg SEMI JOIN b USING (neuron_id, seg_no) WHERE tree_no = 1)
SELECT pt.neuron_id, pt.point_no, CASE WHEN n_children > 1 THEN 'branch' ELSE 'end' END AS kind FROM pt SEMI JOIN q USING (neuron_id, point_no) WHERE parent <> -1 AND n_children <> 1""")
def points_of_long_segments(spark, sf_dir):
    p = arbors(spark, sf_dir)
    segments = k.segment_list(p)
    kinds = segments.where("tree_no = 1").groupBy("neuron_id", "seg_no").agg(F.when(F.count("*") > 8, 2).otherwise(1).alias("kind"))
    return rg.of_kind(p, rg.points_in_region(segments, kinds, 2))


@register("tips_of_long_segments", f"""{WALK}, b AS (SELECT neuron_id, seg_no FROM (SELECT neuron_id, seg_no, count(*) AS n FROM seg WHERE tree_no = 1 GROUP BY ALL) WHERE n > 8),
q AS (SELECT DISTINCT neuron_id, point_no FROM seg SEMI JOIN b USING (neuron_id, seg_no) WHERE tree_no = 1) SELECT pt.neuron_id, pt.point_no FROM pt SEMI JOIN q USING (neuron_id, point_no) WHERE parent <> -1 AND n_children = 0""")
def tips_of_long_segments(spark, sf_dir):
    p = arbors(spark, sf_dir)
    segments = k.segment_list(p)
    kinds = segments.where("tree_no = 1").groupBy("neuron_id", "seg_no").agg(F.when(F.count("*") > 8, 3).otherwise(1).alias("kind"))
    return rg.of_kind(p, rg.points_in_region(segments, kinds, 3), ("end",)).select("neuron_id", "point_no")


SPAN = ", ".join(f"min({a}) AS {a}_min, max({a}) AS {a}_max" for a in "xyz")
AXES_SQL = f"""WITH {ARBORS_SQL}, sp AS (SELECT neuron_id, {SPAN} FROM arbors GROUP BY neuron_id),
co AS (SELECT neuron_id, x_min + neuron_id % 7 AS mx, y_min + neuron_id % 11 AS my, z_min + 1.0 AS mz, x_max - 1 AS lx, y_min + (neuron_id * 37) % 90 AS ly, z_max AS lz FROM sp),
d AS (SELECT *, abs(mx - lx) AS dx, abs(my - ly) AS dy, abs(mz - lz) AS dz FROM co JOIN sp USING (neuron_id)),
w AS (SELECT *, dx < greatest(dx, dy, dz) AND dy = greatest(dx, dy, dz) AS swap FROM d),
ax AS (SELECT neuron_id, swap, CASE WHEN swap THEN CASE WHEN abs(x_min - mx) < abs(x_max - mx) THEN 1 ELSE -1 END ELSE CASE WHEN mx < lx THEN 1 ELSE -1 END END AS sx,
CASE WHEN swap THEN CASE WHEN my < ly THEN 1 ELSE -1 END ELSE CASE WHEN abs(y_min - my) < abs(y_max - my) THEN 1 ELSE -1 END END AS sy, CASE WHEN abs(z_min - mz) > abs(z_max - mz) THEN 1 ELSE -1 END AS sz FROM w)"""


def _axes(spark, sf_dir):
    p = arbors(spark, sf_dir)
    spans = p.groupBy("neuron_id").agg(*[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    n = F.col("neuron_id")
    corners = spans.select("neuron_id", (F.col("x_min") + n % 7).alias("mx"), (F.col("y_min") + n % 11).alias("my"), (F.col("z_min") + 1.0).alias("mz"), (F.col("x_max") - 1).alias("lx"), (F.col("y_min") + (n * 37) % 90).alias("ly"), F.col("z_max").alias("lz"))
    return p, rg.real_axes(corners, spans, "neuron_id")


@register("real_axes", f"{AXES_SQL} SELECT * FROM ax")
def real_axes(spark, sf_dir):
    return _axes(spark, sf_dir)[1]


@register("oriented_neurons", f"{AXES_SQL} SELECT neuron_id, point_no, round(CASE WHEN swap THEN y * sy ELSE x * sx END, 5) AS x, round(CASE WHEN swap THEN x * sx ELSE y * sy END, 5) AS y, round(z * sz, 5) AS z FROM arbors JOIN ax USING (neuron_id)")
def oriented_neurons(spark, sf_dir):
    p, axes = _axes(spark, sf_dir)
    return rg.orient(p, axes, "neuron_id").select("neuron_id", "point_no", *[r(F.col(a), 5).alias(a) for a in "xyz"])


@register("shifted", f"{WITH} SELECT neuron_id, point_no, round(x + 1.5, 5) AS x, round(y - 2.25, 5) AS y, round(z + neuron_id % 3, 5) AS z FROM points")
def shifted(spark, sf_dir):
    return g.shift(points(spark, sf_dir), {"x": 1.5, "y": -2.25, "z": F.col("neuron_id") % 3}).select("neuron_id", "point_no", *[r(F.col(a), 5).alias(a) for a in "xyz"])


@register("shifted_at_random", f"{WITH} SELECT neuron_id, count(*)::BIGINT AS n, true AS alike FROM points GROUP BY neuron_id")
def shifted_at_random(spark, sf_dir):
    p = points(spark, sf_dir)
    moved = g.random_shift(p, 2.0, 7, per="neuron_id").select("neuron_id", "point_no", *[F.col(a).alias("n" + a) for a in "xyz"])
    gaps = p.join(moved, ["neuron_id", "point_no"])
    same = [F.max(F.col("n" + a) - F.col(a)) - F.min(F.col("n" + a) - F.col(a)) < 1e-9 for a in "xyz"]
    return gaps.groupBy("neuron_id").agg(F.count("*").alias("n"), (same[0] & same[1] & same[2]).alias("alike"))


@register("scaled_for_rendering", f"{WITH} SELECT neuron_id, point_no, x, round(-y, 5) AS y, round(-z, 5) AS z FROM points")
def scaled_for_rendering(spark, sf_dir):
    return g.scale(points(spark, sf_dir), {"x": 1.0, "y": -1.0, "z": -1.0}).select("neuron_id", "point_no", "x", *[r(F.col(a), 5).alias(a) for a in "yz"])


@register("mirrored_and_moved", f"{WITH} SELECT neuron_id, point_no, round(50 - x + 3, 5) AS x, round(y + 4, 5) AS y, round(z + 5, 5) AS z FROM points")
def mirrored_and_moved(spark, sf_dir):
    moved = g.transform_points(g.mirror(points(spark, sf_dir), "x", 0, 50), g.translation(3, 4, 5))
    return moved.select("neuron_id", "point_no", *[r(F.col(a), 5).alias(a) for a in "xyz"])


#: Rotations about single axes, as SQL on one axis pair.
TURNS = ", ".join(f"{f}(radians({d})) AS {n}" for d, n in ((10, "1"), (20, "2"), (30, "3")) for f, n in (("cos", "c" + n), ("sin", "s" + n)))


def _turned(name, matrix, first, last):
    """x then y then z (``last`` applied first) as nested SQL steps."""
    steps = {"x": ("x", "c1 * y - s1 * z", "s1 * y + c1 * z"), "y": ("c2 * x - s2 * z", "y", "s2 * x + c2 * z"), "z": ("c3 * x - s3 * y", "s3 * x + c3 * y", "z")}
    sql = "SELECT neuron_id, point_no, x, y, z, " + TURNS + " FROM points"
    for axis in (first, "y", last):
        a = steps[axis]
        sql = f"SELECT neuron_id, point_no, {a[0]} AS x, {a[1]} AS y, {a[2]} AS z, c1, s1, c2, s2, c3, s3 FROM ({sql})"

    @register(name, f"{WITH} SELECT neuron_id, point_no, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM ({sql})")
    def run(spark, sf_dir):
        return g.transform_points(points(spark, sf_dir), matrix()).select("neuron_id", "point_no", *[r(F.col(a)).alias(a) for a in "xyz"])

    return run


_turned("rotated", lambda: g.rotation(10, 20, 30, degrees=True), "z", "x")
_turned("rotated_in_reverse", lambda: reg.inverse_rotation(10, 20, 30, degrees=True), "x", "z")


@register("translated_in_pixels", f"{WITH} SELECT neuron_id, point_no, round(x + 2, 5) AS x, round(y + 2, 5) AS y, round(z + 1, 5) AS z FROM points")
def translated_in_pixels(spark, sf_dir):
    return g.transform_points(points(spark, sf_dir), g.translation(4, 6, 5, (2, 3, 5))).select("neuron_id", "point_no", *[r(F.col(a), 5).alias(a) for a in "xyz"])


#: A registration's parameters on a point: scale, turn about x, y and z, move.
_U = "(x - 1) * sx", "(y - 2) * sy", "(z - 3) * sz"
CHAIN = f"""WITH {POINTS_SQL}, {REGS}, j AS (SELECT p.neuron_id, p.point_no, {_U[0]} AS x, {_U[1]} AS y, {_U[2]} AS z, radians(rx) AS a, radians(ry) AS b, radians(rz) AS c, tx, ty, tz FROM points p JOIN regs ON reg_id = p.neuron_id % 25),
k AS (SELECT * REPLACE (cos(a) * y - sin(a) * z AS y, sin(a) * y + cos(a) * z AS z) FROM j), l AS (SELECT * REPLACE (cos(b) * x + sin(b) * z AS x, -sin(b) * x + cos(b) * z AS z) FROM k), m AS (SELECT * REPLACE (cos(c) * x + sin(c) * y AS x, -sin(c) * x + cos(c) * y AS y) FROM l)
SELECT neuron_id, point_no, round(x + tx + 1, 7) AS x, round(y + ty + 2, 7) AS y, round(z + tz + 3, 7) AS z FROM m"""


def _composed(spark, sf_dir, again=False):
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        p = _params({c: t.column(c).to_pylist() for c in t.column_names})
        p[4] = 1, 2, 3
        m = reg.compose(p)
        if again:
            m = reg.compose(reg.decompose(m, (5, 6, 7)))
        return pa.table({"reg_id": t.column("reg_id"), "matrix": pa.array([m.ravel().tolist()])})

    matrices = regs(spark, sf_dir).groupBy("reg_id").applyInArrow(run, "reg_id long, matrix array<double>")
    moved = reg.transform_by(points(spark, sf_dir).withColumn("reg_id", F.col("neuron_id") % 25), matrices, "reg_id")
    return moved.select("neuron_id", "point_no", *[r(F.col(a), 7).alias(a) for a in "xyz"])


@register("composed_affine", CHAIN)
def composed_affine(spark, sf_dir):
    return _composed(spark, sf_dir)


@register("decomposed_affine", CHAIN)
def decomposed_affine(spark, sf_dir):
    return _composed(spark, sf_dir, again=True)


def _converted(spark, sf_dir, invert):
    """Registrations as typed streams, as rows of sixteen numbers, and back; applied to points."""
    from arborkit.sources import formats as f
    from arborkit.sources.files import decoded, encoded

    def params(c):
        p = _params(c)
        p[4] = 1, 2, 3
        return p

    streams = encoded(regs(spark, sf_dir), "reg_id", [], MOVES, lambda c: f.write_typed_stream(reg.registration(params(c))), "")
    to_text = lambda name, data: [(f.write_transform_text(reg.matrix_of(f.read_typed_stream(data)), invert=invert),)]
    texts = decoded(streams, to_text, "content binary").select("name", "content")

    def to_stream(name, data):
        return [(f.write_typed_stream(reg.registration(reg.decompose(f.read_transform_text(data, invert=invert), (5, 6, 7)))),)]

    again = decoded(texts, to_stream, "content binary").select("name", "content")
    matrices = decoded(again, lambda name, data: [(reg.matrix_of(f.read_typed_stream(data)).ravel().tolist(),)], "matrix array<double>")
    matrices = matrices.select(F.col("name").cast("long").alias("reg_id"), "matrix")
    moved = reg.transform_by(points(spark, sf_dir).withColumn("reg_id", F.col("neuron_id") % 25), matrices, "reg_id")
    return moved.select("neuron_id", "point_no", *[r(F.col(a), 6).alias(a) for a in "xyz"])


_CONVERTED = CHAIN.replace(", 7)", ", 6)")


@register("registrations_converted", _CONVERTED)
def registrations_converted(spark, sf_dir):
    return _converted(spark, sf_dir, False)


@register("registrations_converted_inverse", _CONVERTED)
def registrations_converted_inverse(spark, sf_dir):
    return _converted(spark, sf_dir, True)


#: Landmarks: a customer's balance, key and name digits as a place, moved by a matrix that depends on the nation, with noise.
_MARKS = """mark AS (SELECT c_nationkey AS pair_id, c_custkey AS marker_no, c_acctbal / 1000 AS x, (c_custkey % 17)::DOUBLE AS y, ((c_custkey * 7) % 23)::DOUBLE AS z FROM customer),
kept AS (SELECT * FROM mark WHERE pair_id IN (SELECT pair_id FROM mark GROUP BY 1 HAVING count(*) >= 20))"""
_NAMES = [f"m{i}{j}" for i in range(3) for j in range(4)]
#: Entries of each nation's matrix, k being its key: any affine map, and a turn about z with a shift.
_AFFINE = ["1.2", "0.1", "0.02 * {k}", "3.0 + {k}", "-0.1", "0.9", "0.05", "4.0", "0.01 * {k}", "0.1", "1.1", "-5.0"]
_RIGID = ["cos({k} / 10.0)", "sin({k} / 10.0)", "0.0", "3.0 + {k}", "-sin({k} / 10.0)", "cos({k} / 10.0)", "0.0", "4.0", "0.0", "0.0", "1.0", "-5.0"]
_MOVE = ["1.0", "0.0", "0.0", "3.0 + {k}", "0.0", "1.0", "0.0", "4.0", "0.0", "0.0", "1.0", "-5.0"]
_SCALED = ["1.2 * cos({k} / 10.0)", "0.8 * sin({k} / 10.0)", "0.0", "3.0 + {k}", "-1.2 * sin({k} / 10.0)", "0.8 * cos({k} / 10.0)", "0.0", "4.0", "0.0", "0.0", "1.1", "-5.0"]


def _moved(entries, noise):
    k = [e.format(k="pair_id") for e in entries]
    return ", ".join(f"{k[4 * i]} * x + {k[4 * i + 1]} * y + {k[4 * i + 2]} * z + {k[4 * i + 3]} + {noise.format(i=i)} AS q{a}" for i, a in enumerate("xyz"))


#: Noise of a few tenths; an outlier every fifth marker.
_NOISE, _OUTLIER = "((marker_no * (7 + {i}) + pair_id) % 11 - 5) / 10.0", "CASE WHEN marker_no % 5 = 0 THEN 20.0 + (marker_no * (3 + {i})) % 13 ELSE 0.0 END"


def _least_squares_sql(noise):
    """The affine map of least squares from covariances, by determinants."""
    c = lambda a, b: f"covar_pop({a}, {b})"
    cov = ", ".join(f"{c(a, b)} AS {a}{b}" for a in "xyz" for b in ("x", "y", "z", "qx", "qy", "qz"))
    det = lambda m: f"({m[0][0]}*({m[1][1]}*{m[2][2]} - {m[1][2]}*{m[2][1]}) - {m[0][1]}*({m[1][0]}*{m[2][2]} - {m[1][2]}*{m[2][0]}) + {m[0][2]}*({m[1][0]}*{m[2][1]} - {m[1][1]}*{m[2][0]}))"
    own = [[a + b for b in "xyz"] for a in "xyz"]
    slopes = [", ".join(f"{det([[f'{a}q{t}' if j == n else own[i][j] for j in range(3)] for i, a in enumerate('xyz')])} / {det(own)} AS s{t}{n}" for n in range(3)) for t in "xyz"]
    means = ", ".join(f"avg({a}) AS m{a}" for a in ("x", "y", "z", "qx", "qy", "qz"))
    out = ", ".join(f"round(s{t}0, 4) AS m{i}0, round(s{t}1, 4) AS m{i}1, round(s{t}2, 4) AS m{i}2, round(mq{t} - s{t}0 * mx - s{t}1 * my - s{t}2 * mz, 4) AS m{i}3" for i, t in enumerate("xyz"))
    return f"WITH {_MARKS}, pair AS (SELECT *, {_moved(_AFFINE, noise)} FROM kept), cov AS (SELECT pair_id, {cov}, {means} FROM pair GROUP BY 1), slope AS (SELECT *, {', '.join(slopes)} FROM cov) SELECT pair_id, {out} FROM slope"


def _entries_sql(entries):
    """The matrices that moved the landmarks."""
    return f"WITH {_MARKS} SELECT DISTINCT pair_id, {', '.join(f'round(({e})::DOUBLE, 4) + 0.0::DOUBLE AS {n}' for e, n in zip([e.format(k='pair_id') for e in entries], _NAMES))} FROM kept"


def _fit(name, kind, entries, noise, sql):
    @register(name, sql)
    def run(spark, sf_dir):
        c = table(spark, sf_dir, "customer")
        one = c.select(F.col("c_nationkey").alias("pair_id"), F.col("c_custkey").alias("marker_no"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 17).cast("double").alias("y"), (F.col("c_custkey") * 7 % 23).cast("double").alias("z"))
        one = one.join(one.groupBy("pair_id").count().where("count >= 20").select("pair_id"), "pair_id")
        two = one.selectExpr("pair_id", "marker_no", *_moved(entries, noise).split(", ")).withColumnsRenamed({f"q{a}": a for a in "xyz"})
        fitted = reg.fit_landmarks(one.withColumn("set_no", F.lit(1)).unionByName(two.withColumn("set_no", F.lit(2))), kind)
        return fitted.select("pair_id", *[(r(F.get("matrix", F.lit(i))) + 0.0).alias(c) for i, c in enumerate(_NAMES)])

    return run


_fit("landmark_fit_affine", "affine", _AFFINE, _NOISE, _least_squares_sql(_NOISE))
_fit("landmark_fit_12_parameters", "params12", _AFFINE, _NOISE, _least_squares_sql(_NOISE))
_fit("landmark_fit_absolute", "affine_l1", _AFFINE, _OUTLIER, _entries_sql(_AFFINE))
_fit("landmark_fit_rigid", "rigid", _RIGID, "0.0", _entries_sql(_RIGID))
_fit("landmark_fit_6_parameters", "params6", _RIGID, "0.0", _entries_sql(_RIGID))
_fit("landmark_fit_9_parameters", "params9", _SCALED, "0.0", _entries_sql(_SCALED))
_fit("landmark_fit_3_parameters", "params3", _MOVE, _NOISE, f"WITH {_MARKS}, pair AS (SELECT *, {_moved(_MOVE, _NOISE)} FROM kept) SELECT pair_id, {', '.join(f'{int(i == j)}::DOUBLE AS m{i}{j}' if j < 3 else f'round(avg(q{a} - {a}), 4) AS m{i}3' for i, a in enumerate('xyz') for j in range(4))} FROM pair GROUP BY 1")


@register("flipped_by_registration", f"{WITH} SELECT neuron_id, point_no, round(49 * 1.4 - x, 4) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points")
def flipped_by_registration(spark, sf_dir):
    return g.transform_points(points(spark, sf_dir), reg.compose(reg.flip(0, 50, 1.4))).select("neuron_id", "point_no", r(F.col("x")).alias("x"), r(F.col("y"), 6).alias("y"), r(F.col("z"), 6).alias("z"))


@register("identity_registration", f"{WITH} SELECT neuron_id, point_no, x, round(y, 6) AS y, round(z, 6) AS z FROM points")
def identity_registration(spark, sf_dir):
    m = reg.matrix_of(reg.registration(reg.IDENTITY, legacy=True), inverse=True)
    return g.transform_points(points(spark, sf_dir), m).select("neuron_id", "point_no", "x", *[r(F.col(a), 6).alias(a) for a in "yz"])


@register("tidied", "SELECT n_nationkey, 'boolean' AS empty, '2001-02-03' AS made_date, 'date' AS made_kind, n_nationkey % 2 = 0 AS even, n_name FROM nation")
def tidied(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    raw = n.select("n_nationkey", F.lit(None).cast("string").alias("empty"), F.lit("2001-02-03").alias("made_date"), F.when(F.col("n_nationkey") % 2 == 0, "T").otherwise("F").alias("even"), "n_name")
    out = sc.tidy(raw)
    out = out.withColumn("made_kind", F.lit(out.schema["made_date"].dataType.simpleString())).withColumn("made_date", F.col("made_date").cast("string"))
    return out.withColumn("empty", F.lit(out.schema["empty"].dataType.simpleString()))


@register("merged_fields", "SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 3 > 0 THEN n_name END, lower(n_name)) AS name, n_regionkey AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'x' END AS extra FROM nation")
def merged_fields(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    source = n.where("n_nationkey % 2 = 0 or n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "x").alias("extra"))
    target = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("name"), F.col("n_regionkey").alias("region"))
    return rg.merge_fields(source, target, "id")


@register("sex_filled", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 3 = 1 THEN 'F' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'U' END AS sex FROM customer")
def sex_filled(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k3 = F.col("c_custkey") % 3
    rows = c.select("c_custkey", F.when(k3 == 0, "M").when(k3 == 1, "F").otherwise("U").alias("sex"))
    sheet = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("F").alias("sex"))
    return rg.fill_from(rows, sheet, "c_custkey", "sex", ["M", "F"])


@register("folders", "SELECT page_id, url LIKE '%/' AS is_folder FROM pages")
def folders(spark, sf_dir):
    from arborkit.functions import names

    return table(spark, sf_dir, "pages").select("page_id", names.is_folder(F.col("url")).alias("is_folder"))


@register("fraction_above", f"{WITH} SELECT neuron_id, round(avg(CASE WHEN len >= 20 THEN 1.0 ELSE 0.0 END), 4) AS fraction FROM seglets GROUP BY neuron_id")
def fraction_above(spark, sf_dir):
    return s.fraction_below(s.seglets(points(spark, sf_dir)), 20.0, ">=").select("neuron_id", r(F.col("fraction")).alias("fraction"))
