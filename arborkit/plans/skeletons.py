"""Registered queries on segments of deep, branching trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborkit.catalog import register
from arborkit.operators import skeleton as k
from arborkit.operators import tree
from arborkit.sources.adapters import ARBORS_SQL, arbors

from .morphometry import r

WITH = f"WITH RECURSIVE {ARBORS_SQL}"
#: A tree walked from its roots: ``path`` holds the first point of every segment on the way.
WALK = f"""{WITH}, nc AS (SELECT neuron_id, parent AS point_no, count(*) AS n FROM arbors WHERE parent <> -1 GROUP BY ALL),
pt AS (SELECT a.*, coalesce(nc.n, 0) AS n_children, (a.parent = -1 OR coalesce(nc.n, 0) <> 1) AS is_node FROM arbors a LEFT JOIN nc USING (neuron_id, point_no)),
walk AS (
  SELECT neuron_id, point_no, point_no AS root, point_no AS head, 0 AS pos, 0 AS depth, []::INTEGER[] AS path, is_node FROM pt WHERE parent = -1
  UNION ALL
  SELECT c.neuron_id, c.point_no, w.root, CASE WHEN w.is_node THEN w.point_no ELSE w.head END, CASE WHEN w.is_node THEN 1 ELSE w.pos + 1 END, w.depth + 1,
         CASE WHEN w.is_node THEN list_append(w.path, c.point_no) ELSE w.path END, c.is_node
  FROM walk w JOIN pt c ON c.neuron_id = w.neuron_id AND c.parent = w.point_no),
size AS (SELECT neuron_id, root, count(*) AS n FROM walk GROUP BY ALL),
main AS (SELECT neuron_id, arg_max(root, n * 1000000 - root) AS main_root FROM size GROUP BY neuron_id),
tr AS (SELECT neuron_id, root, row_number() OVER (PARTITION BY neuron_id ORDER BY root <> main_root, root)::INTEGER AS tree_no FROM size JOIN main USING (neuron_id)),
own AS (SELECT w.*, tree_no FROM walk w JOIN tr USING (neuron_id, root)),
named AS (SELECT *, (dense_rank() OVER (PARTITION BY neuron_id, tree_no ORDER BY path))::INTEGER AS seg_no FROM own WHERE pos > 0),
lone AS (SELECT neuron_id, tree_no, 1 AS seg_no, 1 AS seg_order, 0 AS pos, point_no FROM own o WHERE pos = 0 AND NOT EXISTS (SELECT 1 FROM nc WHERE nc.neuron_id = o.neuron_id AND nc.point_no = o.point_no)),
seg AS (
  SELECT neuron_id, tree_no, seg_no, len(path)::INTEGER AS seg_order, pos, point_no FROM named
  UNION ALL SELECT neuron_id, tree_no, seg_no, len(path)::INTEGER, 0, head FROM named WHERE pos = 1
  UNION ALL SELECT * FROM lone),
place AS (SELECT s.*, a.x, a.y, a.z FROM seg s JOIN arbors a USING (neuron_id, point_no)),
piece AS (SELECT *, lead(x) OVER q AS x1, lead(y) OVER q AS y1, lead(z) OVER q AS z1 FROM place WINDOW q AS (PARTITION BY neuron_id, tree_no, seg_no ORDER BY pos)),
long AS (SELECT *, coalesce(sqrt((x1-x)**2 + (y1-y)**2 + (z1-z)**2), 0) AS step FROM piece),
meas AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY neuron_id, tree_no, seg_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, s + step AS s1,
  sum(step) OVER (PARTITION BY neuron_id, tree_no, seg_no) AS total FROM long)"""


def both(spark, sf_dir):
    points = arbors(spark, sf_dir)
    return points, k.segment_list(points)


@register("segment_list", f"{WALK} SELECT * FROM seg")
def segment_list(spark, sf_dir):
    return both(spark, sf_dir)[1]


@register("segment_orders", f"{WALK} SELECT neuron_id, tree_no, seg_no, max(seg_order) AS seg_order FROM seg GROUP BY ALL")
def segment_orders(spark, sf_dir):
    return both(spark, sf_dir)[1].groupBy("neuron_id", "tree_no", "seg_no").agg(F.max("seg_order").alias("seg_order"))


@register("lengths_of_segments", f"{WALK} SELECT neuron_id, tree_no, seg_no, seg_order, round(sum(step), 4) AS length, count(*)::BIGINT AS n_points FROM long GROUP BY ALL")
def lengths_of_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.segment_lengths(segments, points).withColumn("length", r(F.col("length")))


@register("neuron_summary", f"""{WALK}, k AS (SELECT neuron_id, count(*) AS n_points,
  list_sort(coalesce(list(point_no) FILTER (WHERE parent <> -1 AND n_children > 1), [])) AS b, list_sort(coalesce(list(point_no) FILTER (WHERE n_children = 0 OR parent = -1 AND n_children <= 1), [])) AS e FROM pt GROUP BY neuron_id),
c AS (SELECT neuron_id, max(point_no) FILTER (WHERE tree_no = 1 AND seg_no = 1 AND pos = 0) AS start_point, max(tree_no) AS n_trees, max(seg_no) FILTER (WHERE tree_no = 1) AS n_segs FROM seg GROUP BY neuron_id)
SELECT neuron_id, n_points, array_to_string(b, ',') AS branch_points, array_to_string(e, ',') AS end_points, start_point, n_trees, n_segs FROM k JOIN c USING (neuron_id)""")
def neuron_summary(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    out = k.neuron_summary(points, segments)
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("branch_points", "end_points")})


@register("segment_edges", f"{WALK} SELECT neuron_id, point_no AS src, lead AS dst FROM (SELECT *, lead(point_no) OVER (PARTITION BY neuron_id, tree_no, seg_no ORDER BY pos) AS lead FROM seg) WHERE lead IS NOT NULL")
def segment_edges(spark, sf_dir):
    return k.segment_edges(both(spark, sf_dir)[1])


@register("segment_adjacency", f"{WITH} SELECT neuron_id, parent AS row, point_no AS col, 1 AS value FROM arbors WHERE parent <> -1 UNION SELECT neuron_id, point_no, parent, 1 FROM arbors WHERE parent <> -1")
def segment_adjacency(spark, sf_dir):
    return k.adjacency(k.segment_edges(both(spark, sf_dir)[1]), undirected=True)


@register("reduced_segment_adjacency", f"{WALK}, e AS (SELECT neuron_id, tree_no, seg_no, arg_min(point_no, pos) AS row, arg_max(point_no, pos) AS col, max(pos) AS m FROM seg GROUP BY ALL) SELECT DISTINCT neuron_id, row, col, 1 AS value FROM e WHERE m > 0")
def reduced_segment_adjacency(spark, sf_dir):
    return k.adjacency(k.segment_ends(both(spark, sf_dir)[1]))


@register("edge_adjacency", f"{WITH} SELECT neuron_id, parent AS row, point_no AS col, 1 AS value FROM arbors WHERE parent <> -1")
def edge_adjacency(spark, sf_dir):
    return k.adjacency(tree.edges(arbors(spark, sf_dir)))


@register("child_parent_adjacency", f"{WITH} SELECT neuron_id, point_no AS row, parent AS col, 1 AS value FROM arbors WHERE parent <> -1")
def child_parent_adjacency(spark, sf_dir):
    return k.adjacency(tree.edges(arbors(spark, sf_dir)).selectExpr("neuron_id", "dst AS src", "src AS dst"))


@register("reduced_edge_adjacency", f"""{WITH}, e AS (SELECT neuron_id, parent AS row, point_no AS col FROM arbors WHERE parent <> -1 UNION SELECT neuron_id, point_no, parent FROM arbors WHERE parent <> -1),
d AS (SELECT neuron_id, row FROM e GROUP BY ALL HAVING count(*) <> 2) SELECT e.neuron_id, e.row, e.col, 1 AS value FROM e SEMI JOIN d ON d.neuron_id = e.neuron_id AND d.row = e.row SEMI JOIN d d2 ON d2.neuron_id = e.neuron_id AND d2.row = e.col""")
def reduced_edge_adjacency(spark, sf_dir):
    return k.reduced_adjacency(tree.edges(arbors(spark, sf_dir)))


@register("sub_trees", f"{WALK}, t AS (SELECT neuron_id, root, point_no, min(point_no) OVER (PARTITION BY neuron_id, root) AS tree, count(*) OVER (PARTITION BY neuron_id, root) AS n FROM walk) SELECT neuron_id, point_no, tree FROM t WHERE n > 1")
def sub_trees(spark, sf_dir):
    return k.sub_trees(tree.edges(arbors(spark, sf_dir)))


@register("trees_in_edge_list", f"{WITH}, e AS (SELECT neuron_id, parent AS a, point_no AS b FROM arbors WHERE parent <> -1), v AS (SELECT neuron_id, a AS v FROM e UNION SELECT neuron_id, b FROM e) SELECT neuron_id, (nv - ne)::BIGINT AS n_trees FROM (SELECT neuron_id, count(*) AS nv FROM v GROUP BY 1) JOIN (SELECT neuron_id, count(*) AS ne FROM e GROUP BY 1) USING (neuron_id)")
def trees_in_edge_list(spark, sf_dir):
    return tree.trees_in_edges(tree.double_edges(tree.edges(arbors(spark, sf_dir))))


GRAPH = f"{WITH}, e AS (SELECT neuron_id, parent AS src, point_no AS dst FROM arbors WHERE parent <> -1), v AS (SELECT neuron_id, label, row_number() OVER (PARTITION BY neuron_id ORDER BY label)::INTEGER AS vertex FROM (SELECT neuron_id, src AS label FROM e UNION SELECT neuron_id, dst FROM e))"


@register("graph_vertices", f"{GRAPH} SELECT * FROM v")
def graph_vertices(spark, sf_dir):
    points = arbors(spark, sf_dir)
    return k.graph(points, tree.edges(points))[0]


@register("graph_edges", f"{GRAPH} SELECT e.neuron_id, a.vertex AS src_vertex, b.vertex AS dst_vertex FROM e JOIN v a ON a.neuron_id = e.neuron_id AND a.label = src JOIN v b ON b.neuron_id = e.neuron_id AND b.label = dst")
def graph_edges(spark, sf_dir):
    points = arbors(spark, sf_dir)
    return k.graph(points, tree.edges(points))[1]


@register("graph_of_segments", f"{GRAPH} SELECT e.neuron_id, a.vertex AS src_vertex, b.vertex AS dst_vertex FROM e JOIN v a ON a.neuron_id = e.neuron_id AND a.label = src JOIN v b ON b.neuron_id = e.neuron_id AND b.label = dst")
def graph_of_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.graph(points, k.segment_edges(segments))[1]


@register("parents_from_segments", f"{WITH} SELECT neuron_id, point_no, parent FROM arbors")
def parents_from_segments(spark, sf_dir):
    return k.parents_from_segments(both(spark, sf_dir)[1])


@register("point_neighbours", f"""{WITH}, c AS (SELECT neuron_id, parent AS point_no, list_sort(list(point_no)) AS below FROM arbors WHERE parent <> -1 GROUP BY ALL)
SELECT neuron_id, point_no, array_to_string(list_concat(CASE WHEN parent = -1 THEN [] ELSE [parent] END, coalesce(below, [])), ',') AS neighbours FROM arbors LEFT JOIN c USING (neuron_id, point_no)""")
def point_neighbours(spark, sf_dir):
    return k.neighbours(arbors(spark, sf_dir)).withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ","))


ENDS = "ends AS (SELECT neuron_id, max(point_no) AS dst, max(point_no) // 3 AS src FROM arbors GROUP BY neuron_id)"
PATH = f"""{WITH}, {ENDS},
ua AS (SELECT a.neuron_id, a.point_no, a.parent, 0 AS step FROM ends e JOIN arbors a ON a.neuron_id = e.neuron_id AND a.point_no = e.src UNION ALL SELECT a.neuron_id, a.point_no, a.parent, u.step + 1 FROM ua u JOIN arbors a ON a.neuron_id = u.neuron_id AND a.point_no = u.parent),
ub AS (SELECT a.neuron_id, a.point_no, a.parent, 0 AS step FROM ends e JOIN arbors a ON a.neuron_id = e.neuron_id AND a.point_no = e.dst UNION ALL SELECT a.neuron_id, a.point_no, a.parent, u.step + 1 FROM ub u JOIN arbors a ON a.neuron_id = u.neuron_id AND a.point_no = u.parent),
meet AS (SELECT ua.neuron_id, min(ua.step) AS sa, min(ub.step) AS sb FROM ua JOIN ub USING (neuron_id, point_no) GROUP BY ua.neuron_id),
way AS (SELECT neuron_id, step::INTEGER AS step, point_no FROM ua JOIN meet USING (neuron_id) WHERE step <= sa UNION ALL SELECT neuron_id, (sa + sb - step)::INTEGER, point_no FROM ub JOIN meet USING (neuron_id) WHERE step < sb)"""


def _path(spark, sf_dir):
    points = arbors(spark, sf_dir)
    ends = points.groupBy("neuron_id").agg(F.max("point_no").alias("dst")).withColumn("src", F.floor(F.col("dst") / 3).cast("int"))
    return points, k.path_between(points, ends)


@register("path_between", f"{PATH} SELECT * FROM way")
def path_between(spark, sf_dir):
    return _path(spark, sf_dir)[1]


@register("sub_neuron", f"{WALK}, {PATH.removeprefix(WITH + ', ')}, x AS (SELECT neuron_id, tree_no, seg_no, arg_min(point_no, pos) AS a, arg_max(point_no, pos) AS b, max(pos) AS m FROM seg GROUP BY ALL), g AS (SELECT x.* FROM x WHERE m > 0 AND EXISTS (SELECT 1 FROM way w WHERE w.neuron_id = x.neuron_id AND w.point_no = x.a) AND EXISTS (SELECT 1 FROM way w WHERE w.neuron_id = x.neuron_id AND w.point_no = x.b)) SELECT seg.* FROM seg SEMI JOIN g USING (neuron_id, tree_no, seg_no)")
def sub_neuron(spark, sf_dir):
    points, path = _path(spark, sf_dir)
    return k.sub_neuron(k.segment_list(points), path)


@register("merge_paths", f"""{WITH}, p AS (SELECT *, point_no % 3 AS path FROM arbors), o AS (SELECT *, row_number() OVER (PARTITION BY neuron_id, path ORDER BY point_no) AS place, dense_rank() OVER (PARTITION BY neuron_id ORDER BY path)::INTEGER AS sub_tree FROM p),
z AS (SELECT neuron_id, path, count(*) AS n FROM p GROUP BY ALL), h AS (SELECT neuron_id, path, coalesce(sum(n) OVER (PARTITION BY neuron_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM z)
SELECT o.neuron_id, (o.place + shift)::INTEGER AS point_no, coalesce(q.place + shift, -1)::INTEGER AS parent, o.sub_tree, o.x, o.y, o.z FROM o JOIN h USING (neuron_id, path) LEFT JOIN o q ON q.neuron_id = o.neuron_id AND q.path = o.path AND q.point_no = o.parent""")
def merge_paths(spark, sf_dir):
    return k.merge_paths(arbors(spark, sf_dir).withColumn("path", F.col("point_no") % 3), "path")


@register("seglets_of_segments", f"{WALK} SELECT neuron_id, tree_no, seg_no, pos, x AS x0, y AS y0, z AS z0, x1, y1, z1, round(step, 6) AS len FROM long WHERE x1 IS NOT NULL")
def seglets_of_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.start_end_list(segments, points).withColumn("len", r(F.col("len"), 6))


@register("midpoints_of_segments", f"{WALK} SELECT neuron_id, tree_no, seg_no, pos, round((x + x1) / 2, 6) AS x, round((y + y1) / 2, 6) AS y, round((z + z1) / 2, 6) AS z, round(step, 6) AS weight FROM long WHERE x1 IS NOT NULL")
def midpoints_of_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    rows = k.start_end_list(segments, points)
    return rows.select("neuron_id", "tree_no", "seg_no", "pos", *[r((F.col(a + "0") + F.col(a + "1")) / 2, 6).alias(a) for a in "xyz"], r(F.col("len"), 6).alias("weight"))


SMOOTH = ", ".join(f"round(CASE WHEN pos > 0 AND x1 IS NOT NULL AND n > 3 THEN 0.25 * lag({a}) OVER q + 0.5 * {a} + 0.25 * lead({a}) OVER q ELSE {a} END, 6) AS {a}" for a in "xyz")


@register("smooth_segments", f"{WALK}, c AS (SELECT *, count(*) OVER (PARTITION BY neuron_id, tree_no, seg_no) AS n FROM long) SELECT neuron_id, tree_no, seg_no, pos, point_no, {SMOOTH} FROM c WINDOW q AS (PARTITION BY neuron_id, tree_no, seg_no ORDER BY pos)")
def smooth_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.smooth_segments(segments, points).select("neuron_id", "tree_no", "seg_no", "pos", "point_no", *[r(F.col(a), 6).alias(a) for a in "xyz"])


@register("resample_segments", f"""{WALK}, i AS (SELECT *, unnest(range(floor(s / 20)::BIGINT + 1, ceil(s1 / 20)::BIGINT)) * 20.0::DOUBLE AS spot FROM meas WHERE x1 IS NOT NULL),
n AS (SELECT neuron_id, tree_no, seg_no, spot AS s, x + (spot - s) / (s1 - s) * (x1 - x) AS x, y + (spot - s) / (s1 - s) * (y1 - y) AS y, z + (spot - s) / (s1 - s) * (z1 - z) AS z FROM i WHERE spot < total
UNION ALL SELECT neuron_id, tree_no, seg_no, s, x, y, z FROM meas WHERE x1 IS NULL OR pos = 0 AND seg_no = 1)
SELECT neuron_id, tree_no, seg_no, round(s, 7) AS s, round(x, 7) AS x, round(y, 7) AS y, round(z, 7) AS z FROM n""")
def resample_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.resample_segments(segments, points, 20.0).select("neuron_id", "tree_no", "seg_no", *[r(F.col(a), 7).alias(a) for a in ("s", *"xyz")])


@register("divide_segments", f"""{WALK}, p AS (SELECT neuron_id, tree_no, seg_no, total, unnest(range(0, 5)) AS part FROM meas WHERE pos = 0 AND total > 0),
j AS (SELECT p.*, m.x + (part * p.total / 4 - s) / (s1 - s) * (x1 - x) AS x, m.y + (part * p.total / 4 - s) / (s1 - s) * (y1 - y) AS y, m.z + (part * p.total / 4 - s) / (s1 - s) * (z1 - z) AS z
FROM p JOIN meas m USING (neuron_id, tree_no, seg_no) WHERE x1 IS NOT NULL AND part > 0 AND part < 4 AND s <= part * p.total / 4 AND part * p.total / 4 < s1)
SELECT neuron_id, tree_no, seg_no, part::INTEGER AS part, round(x, 7) AS x, round(y, 7) AS y, round(z, 7) AS z FROM j
UNION ALL SELECT neuron_id, tree_no, seg_no, CASE WHEN pos = 0 THEN 0 ELSE 4 END, round(x, 7), round(y, 7), round(z, 7) FROM meas WHERE total > 0 AND (pos = 0 OR x1 IS NULL)""")
def divide_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.divide_segments(segments, points, 4).select("neuron_id", "tree_no", "seg_no", "part", *[r(F.col(a), 7).alias(a) for a in "xyz"])


@register("longest_segments", f"""{WALK}, t AS (SELECT neuron_id, tree_no, seg_no, sum(step) AS length FROM long GROUP BY ALL),
b AS (SELECT neuron_id, tree_no, seg_no FROM t QUALIFY row_number() OVER (PARTITION BY neuron_id ORDER BY length DESC, tree_no, seg_no) = 1) SELECT neuron_id, pos, point_no FROM seg SEMI JOIN b USING (neuron_id, tree_no, seg_no)""")
def longest_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.longest_segment(segments, points).select("neuron_id", "pos", "point_no")


@register("partition_neuron")
def partition_neuron(spark, sf_dir):
    segments = both(spark, sf_dir)[1].where("tree_no = 1")
    tails = segments.groupBy("neuron_id", "seg_no", "seg_order").agg(F.max_by("point_no", "pos").alias("tail"))
    ranked = lambda order: F.min(F.when(F.col("seg_order") == order, F.col("tail")))
    keys = tails.groupBy("neuron_id").agg(ranked(4).alias("lh_branch_point"), F.array(ranked(1), ranked(3)).alias("mb_points"))
    return k.partition(segments, keys)


@register("spline_smooth_segments")
def spline_smooth_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.spline_smooth(segments, points).select("neuron_id", "tree_no", "seg_no", "pos", *[r(F.col(a)).alias(a) for a in "xyz"])


@register("bspline_smooth_segments")
def bspline_smooth_segments(spark, sf_dir):
    points, segments = both(spark, sf_dir)
    return k.bspline_smooth(segments, points).select("neuron_id", "tree_no", "seg_no", "pos", *[r(F.col(a)).alias(a) for a in "xyz"])


@register("lengths_filled", f"{WALK}, l AS (SELECT neuron_id, round(sum(step), 4) AS length FROM long GROUP BY 1) SELECT neuron_id, CASE WHEN neuron_id % 3 = 0 THEN -1.0 ELSE length END AS length FROM l")
def lengths_filled(spark, sf_dir):
    """Neurons that have a length keep it, the others get theirs."""
    points, segments = both(spark, sf_dir)
    known = points.select("neuron_id").distinct().withColumn("length", F.when(F.col("neuron_id") % 3 == 0, -1.0))
    new = k.segment_lengths(segments, points).groupBy("neuron_id").agg(r(F.sum("length")).alias("new"))
    return known.join(new, "neuron_id").select("neuron_id", F.coalesce("length", "new").alias("length"))


@register("key_points_filled", f"{WALK}, t AS (SELECT neuron_id, seg_no, max(seg_order) AS o, arg_max(point_no, pos) AS tail FROM seg WHERE tree_no = 1 GROUP BY ALL), q AS (SELECT neuron_id, min(tail) FILTER (WHERE o = 2) AS p FROM t GROUP BY 1) SELECT neuron_id, CASE WHEN neuron_id % 2 = 0 THEN 7 ELSE p END AS branch_point FROM q")
def key_points_filled(spark, sf_dir):
    """Key points given by a table; where none is, the least tail of the second order's segments."""
    segments = both(spark, sf_dir)[1].where("tree_no = 1")
    tails = segments.groupBy("neuron_id", "seg_no", "seg_order").agg(F.max_by("point_no", "pos").alias("tail"))
    found = tails.groupBy("neuron_id").agg(F.min(F.when(F.col("seg_order") == 2, F.col("tail"))).alias("found"))
    given = found.where("neuron_id % 2 = 0").select("neuron_id", F.lit(7).alias("given"))
    return found.join(given, "neuron_id", "left").select("neuron_id", F.coalesce("given", "found").alias("branch_point"))


@register("neurons_in_order", "SELECT o_orderkey AS neuron_id, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders")
def neurons_in_order(spark, sf_dir):
    from arborkit.operators.matching import numbered
    from arborkit.sources.adapters import neurons

    return numbered(neurons(spark, sf_dir).select("neuron_id", "brain"), [F.col("brain"), F.col("neuron_id")]).select("neuron_id", "place")
