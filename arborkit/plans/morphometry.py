"""Registered queries on trees, segments, geometry and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborkit.catalog import register
from arborkit.functions import names
from arborkit.operators import geometry as g
from arborkit.operators import segments as s
from arborkit.operators import tree
from arborkit.sources.adapters import POINTS_SQL, neurons, points, table

#: Decimals kept of computed doubles, on both sides.
DIGITS = 4


def r(column, digits: int = DIGITS):
    return F.round(column, digits) + F.lit(0.0)


WITH = f"WITH RECURSIVE {POINTS_SQL}"


@register("arbour_length_by_type", f"""{WITH}
SELECT cell_type, round(sum(len), 2) AS length, count(*)::BIGINT AS n_seglets, count(DISTINCT s.neuron_id)::BIGINT AS n_neurons
FROM seglets s JOIN neurons n USING (neuron_id) GROUP BY cell_type""")
def arbour_length_by_type(spark, sf_dir):
    per_neuron = s.arbour_length(s.seglets(points(spark, sf_dir)))
    joined = per_neuron.join(neurons(spark, sf_dir), "neuron_id")
    return joined.groupBy("cell_type").agg(r(F.sum("length"), 2).alias("length"), F.sum("n_seglets").alias("n_seglets"), F.count("*").alias("n_neurons"))


@register("segment_lengths", f"{WITH} SELECT neuron_id, round(sum(len), 4) AS length, count(*)::BIGINT AS n_seglets FROM seglets GROUP BY neuron_id")
def segment_lengths(spark, sf_dir):
    out = s.arbour_length(s.seglets(points(spark, sf_dir)))
    return out.select("neuron_id", r(F.col("length")).alias("length"), "n_seglets")


@register("segment_midpoints", f"{WITH} SELECT neuron_id, point_no, round((x0+x1)/2, 7) AS x, round((y0+y1)/2, 7) AS y, round((z0+z1)/2, 7) AS z, round(len, 7) AS weight FROM seglets")
def segment_midpoints(spark, sf_dir):
    return s.midpoints(s.seglets(points(spark, sf_dir))).select("neuron_id", "point_no", *[r(F.col(c), 7).alias(c) for c in ("x", "y", "z", "weight")])


@register("fraction_below", f"{WITH} SELECT neuron_id, round(avg(CASE WHEN len < 20 THEN 1.0 ELSE 0.0 END), 4) AS fraction FROM seglets GROUP BY neuron_id")
def fraction_below(spark, sf_dir):
    return s.fraction_below(s.seglets(points(spark, sf_dir)), 20.0).select("neuron_id", r(F.col("fraction")).alias("fraction"))


@register("edge_list", f"{WITH} SELECT neuron_id, parent AS src, point_no AS dst FROM points WHERE parent <> -1")
def edge_list(spark, sf_dir):
    return tree.edges(points(spark, sf_dir))


@register("double_edge_list", f"{WITH} SELECT neuron_id, parent AS src, point_no AS dst FROM points WHERE parent <> -1 UNION SELECT neuron_id, point_no, parent FROM points WHERE parent <> -1")
def double_edge_list(spark, sf_dir):
    return tree.double_edges(tree.edges(points(spark, sf_dir)))


@register("single_from_double_edges", f"{WITH} SELECT DISTINCT neuron_id, least(parent, point_no) AS src, greatest(parent, point_no) AS dst FROM points WHERE parent <> -1")
def single_from_double_edges(spark, sf_dir):
    return tree.single_edges(tree.double_edges(tree.edges(points(spark, sf_dir))))


@register("point_classes", f"""{WITH}, c AS (SELECT neuron_id, parent AS point_no, count(*) AS n FROM points WHERE parent <> -1 GROUP BY ALL)
SELECT p.neuron_id, p.point_no, coalesce(c.n, 0)::BIGINT AS n_children,
CASE WHEN p.parent = -1 THEN 'root' WHEN c.n > 1 THEN 'branch' WHEN c.n IS NULL THEN 'end' ELSE 'slab' END AS kind
FROM points p LEFT JOIN c USING (neuron_id, point_no)""")
def point_classes(spark, sf_dir):
    return tree.point_classes(points(spark, sf_dir)).select("neuron_id", "point_no", "n_children", "kind")


@register("tree_counts", f"{WITH} SELECT neuron_id, count(*)::BIGINT AS n_points, count(*) FILTER (WHERE parent <> -1)::BIGINT AS n_edges, count(*) FILTER (WHERE parent = -1)::BIGINT AS n_trees FROM points GROUP BY neuron_id")
def tree_counts(spark, sf_dir):
    return tree.tree_counts(points(spark, sf_dir))


@register("point_depths", f"""{WITH}, walk AS (
SELECT neuron_id, point_no, 0 AS depth FROM points WHERE parent = -1 UNION ALL
SELECT p.neuron_id, p.point_no, w.depth + 1 FROM walk w JOIN points p ON p.neuron_id = w.neuron_id AND p.parent = w.point_no)
SELECT neuron_id, point_no, depth FROM walk""")
def point_depths(spark, sf_dir):
    return tree.depths(points(spark, sf_dir))


@register("branch_orders", f"""{WITH}, c AS (SELECT neuron_id, parent AS point_no, count(*) AS n FROM points WHERE parent <> -1 GROUP BY ALL),
k AS (SELECT p.neuron_id, p.point_no, p.parent, CASE WHEN c.n > 1 THEN 1 ELSE 0 END AS branch FROM points p LEFT JOIN c USING (neuron_id, point_no)),
walk AS (SELECT neuron_id, point_no, 0 AS branch_order, branch FROM k WHERE parent = -1 UNION ALL
SELECT k.neuron_id, k.point_no, w.branch_order + w.branch, k.branch FROM walk w JOIN k ON k.neuron_id = w.neuron_id AND k.parent = w.point_no)
SELECT neuron_id, point_no, branch_order FROM walk""")
def branch_orders(spark, sf_dir):
    return tree.branch_orders(points(spark, sf_dir))


@register("path_to_root", f"""{WITH}, far AS (SELECT neuron_id, max(point_no) AS point_no FROM points GROUP BY neuron_id),
up AS (SELECT p.neuron_id, p.point_no AS start, p.point_no, p.parent, 0 AS step FROM far f JOIN points p USING (neuron_id, point_no) UNION ALL
SELECT u.neuron_id, u.start, p.point_no, p.parent, u.step + 1 FROM up u JOIN points p ON p.neuron_id = u.neuron_id AND p.point_no = u.parent)
SELECT neuron_id, start, step, point_no FROM up""")
def path_to_root(spark, sf_dir):
    p = points(spark, sf_dir)
    return tree.path_to_root(p, p.groupBy("neuron_id").agg(F.max("point_no").alias("point_no")))


@register("reroot", f"""{WITH}, far AS (SELECT neuron_id, max(point_no) AS point_no FROM points GROUP BY neuron_id),
up AS (SELECT p.neuron_id, p.point_no, p.parent, -1 AS was FROM far f JOIN points p USING (neuron_id, point_no) UNION ALL
SELECT p.neuron_id, p.point_no, p.parent, u.point_no FROM up u JOIN points p ON p.neuron_id = u.neuron_id AND p.point_no = u.parent)
SELECT p.neuron_id, p.point_no, coalesce(u.was, p.parent) AS parent FROM points p LEFT JOIN up u USING (neuron_id, point_no)""")
def reroot(spark, sf_dir):
    p = points(spark, sf_dir)
    return tree.reroot(p, p.groupBy("neuron_id").agg(F.max("point_no").alias("point_no"))).select("neuron_id", "point_no", "parent")


@register("side_of_plane", f"{WITH} SELECT neuron_id, point_no, round(0.5*x - 1.25*y + 2*z - 10, 8) AS side FROM points")
def side_of_plane(spark, sf_dir):
    return points(spark, sf_dir).select("neuron_id", "point_no", r(g.side_of_plane((0.5, -1.25, 2.0, -10.0)), 8).alias("side"))


@register("restrict_to_bounds", f"{WITH} SELECT neuron_id, point_no, x, y, z FROM points WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 60 AND z BETWEEN 2 AND 8")
def restrict_to_bounds(spark, sf_dir):
    return g.restrict_to_bounds(points(spark, sf_dir), {"x": (10, 40), "y": (5, 60), "z": (2, 8)}).select("neuron_id", "point_no", "x", "y", "z")


@register("mirror", f"{WITH} SELECT neuron_id, point_no, round(50 - x, 4) AS x, y, z FROM points")
def mirror(spark, sf_dir):
    return g.mirror(points(spark, sf_dir), "x", 0, 50).select("neuron_id", "point_no", r(F.col("x")).alias("x"), "y", "z")


@register("blend", f"{WITH} SELECT neuron_id, point_no, round(0.7*x + 0.3*(x+5), 8) AS x, round(0.7*y + 0.3*(y*2), 8) AS y, round(z, 8) AS z, round(w, 8) AS w FROM points")
def blend(spark, sf_dir):
    p = points(spark, sf_dir)
    after = g.scale(g.shift(p, {"x": 5.0}), {"y": 2.0})
    return g.blend(p, after, ["neuron_id", "point_no"], 0.3).select("neuron_id", "point_no", *[r(F.col(c), 8).alias(c) for c in "xyzw"])


@register("affine_transform", f"""{WITH} SELECT neuron_id, point_no, round(2*(x*cos(pi()/6) - y*sin(pi()/6)) + 2*(cos(pi()/6)*3 - sin(pi()/6)*4), 4) AS x,
round(2*(x*sin(pi()/6) + y*cos(pi()/6)) + 2*(sin(pi()/6)*3 + cos(pi()/6)*4), 4) AS y, round(2*z + 10, 4) AS z FROM points""")
def affine_transform(spark, sf_dir):
    m = g.scale_rotate_translate(g.scaling(2, 2, 2), g.rotation(0, 0, 30, degrees=True), g.translation(3, 4, 5))
    return g.transform_points(points(spark, sf_dir), m).select("neuron_id", "point_no", *[r(F.col(c)).alias(c) for c in "xyz"])


@register("plane_intersections", f"""{WITH}, u AS (SELECT *, (x0 - 25) / nullif(x0 - x1, 0) AS u FROM seglets)
SELECT neuron_id, point_no, round(x0 + u*(x1-x0), 9) AS x, round(y0 + u*(y1-y0), 9) AS y, round(z0 + u*(z1-z0), 9) AS z FROM u WHERE u BETWEEN 0 AND 1""")
def plane_intersections(spark, sf_dir):
    hits = g.intersect_segment_with_plane(s.seglets(points(spark, sf_dir)), (1.0, 0.0, 0.0, -25.0))
    return hits.select("neuron_id", "point_no", *[r(F.col(c), 9).alias(c) for c in "xyz"])


@register("angle_between", f"""{WITH}, t AS (SELECT neuron_id, point_no, x0*x1 + y0*y1 + z0*z1 AS d, sqrt(x0*x0+y0*y0+z0*z0) * sqrt(x1*x1+y1*y1+z1*z1) AS n FROM seglets)
SELECT neuron_id, point_no, round(acos(greatest(-1.0, least(1.0, d / n))), 3) AS theta FROM t""")
def angle_between(spark, sf_dir):
    return s.seglets(points(spark, sf_dir)).select("neuron_id", "point_no", r(g.angle_between(("x0", "y0", "z0"), ("x1", "y1", "z1")), 3).alias("theta"))


@register("tetrahedron_volume", f"""{WITH} SELECT neuron_id, point_no, round((x0*(y1*3 - z1*2) + y0*(z1*1 - x1*3) + z0*(x1*2 - y1*1))/6, 7) AS volume FROM seglets""")
def tetrahedron_volume(spark, sf_dir):
    rows = s.seglets(points(spark, sf_dir)).withColumns({"c0": F.lit(1.0), "c1": F.lit(2.0), "c2": F.lit(3.0)})
    return rows.select("neuron_id", "point_no", r(g.tetrahedron_volume(["x0", "y0", "z0"], ["x1", "y1", "z1"], ["c0", "c1", "c2"]), 7).alias("volume"))


@register("arc_length", f"""{WITH}, d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER q)**2 + (y - lag(y) OVER q)**2 + (z - lag(z) OVER q)**2), 0) AS step FROM points WINDOW q AS (PARTITION BY neuron_id ORDER BY point_no))
SELECT neuron_id, point_no, round(sum(step) OVER (PARTITION BY neuron_id ORDER BY point_no ROWS UNBOUNDED PRECEDING), 4) AS s FROM d""")
def arc_length(spark, sf_dir):
    return s.polyline(points(spark, sf_dir)).select("neuron_id", "point_no", r(F.col("s")).alias("s"))


@register("resample", f"""{WITH}, d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER q)**2 + (y - lag(y) OVER q)**2 + (z - lag(z) OVER q)**2), 0) AS step FROM points WINDOW q AS (PARTITION BY neuron_id ORDER BY point_no)),
l AS (SELECT *, sum(step) OVER (PARTITION BY neuron_id ORDER BY point_no ROWS UNBOUNDED PRECEDING) AS s FROM d),
m AS (SELECT *, lead(s) OVER q AS s1, lead(x) OVER q AS x1, lead(y) OVER q AS y1, lead(z) OVER q AS z1 FROM l WINDOW q AS (PARTITION BY neuron_id ORDER BY point_no)),
e AS (SELECT *, unnest(range(ceil(s/10)::BIGINT, ceil(s1/10)::BIGINT)) * 10 AS pos FROM m WHERE s1 IS NOT NULL)
SELECT neuron_id, round(pos, 8) AS s, round(x + (pos-s)/(s1-s)*(x1-x), 8) AS x, round(y + (pos-s)/(s1-s)*(y1-y), 8) AS y, round(z + (pos-s)/(s1-s)*(z1-z), 8) AS z FROM e
UNION ALL SELECT neuron_id, round(s, 8), round(x, 8), round(y, 8), round(z, 8) FROM m WHERE s1 IS NULL""")
def resample(spark, sf_dir):
    return s.resample(points(spark, sf_dir), 10.0).select("neuron_id", *[r(F.col(c), 8).alias(c) for c in ("s", "x", "y", "z")])


@register("moving_average", f"""{WITH} SELECT neuron_id, point_no,
{', '.join(f'round(coalesce((lag({c}) OVER q + 2*{c} + lead({c}) OVER q)/4, {c}), 8) AS {c}' for c in 'xyz')} FROM points WINDOW q AS (PARTITION BY neuron_id ORDER BY point_no)""")
def moving_average(spark, sf_dir):
    return s.moving_average(points(spark, sf_dir), (1.0, 2.0, 1.0)).select("neuron_id", "point_no", *[r(F.col(c), 8).alias(c) for c in "xyz"])


@register("longest_neurons", f"""{WITH} SELECT cell_type, neuron_id, length, rank FROM (
SELECT cell_type, neuron_id, length, row_number() OVER (PARTITION BY cell_type ORDER BY length DESC, neuron_id)::INTEGER AS rank FROM (
SELECT neuron_id, round(sum(len), 4) AS length FROM seglets GROUP BY neuron_id) JOIN neurons USING (neuron_id)) WHERE rank <= 3""")
def longest_neurons(spark, sf_dir):
    from arborkit.operators.stats import first_n

    lengths = s.arbour_length(s.seglets(points(spark, sf_dir))).select("neuron_id", r(F.col("length")).alias("length"))
    ranked = first_n(lengths.join(neurons(spark, sf_dir), "neuron_id").withColumn("minus", -F.col("length")), "cell_type", ["minus", "neuron_id"], 3)
    return ranked.select("cell_type", "neuron_id", "length", "rank")


@register("image_names", "SELECT page_id, string_split_regex(url, '[._]')[1] AS image, CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END AS folder FROM pages")
def image_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", names.image_name(F.col("url")).alias("image"), names.as_folder(F.col("url")).alias("folder"))


@register("projection_classes", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)np|mz|acj6') THEN 'LHN' WHEN regexp_matches(p_name, '^v') THEN 'mPN' ELSE 'iPN' END AS class FROM part")
def projection_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.projection_class(F.col("p_name")).alias("class"))
