"""Registered queries on tangents, nearest points, pair scores and alignments."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborkit.catalog import register
from arborkit.operators import matching as m
from arborkit.operators import segments as s
from arborkit.operators import similarity as sim
from arborkit.operators import skeleton as k
from arborkit.sources.adapters import ARBORS_SQL, POINTS_SQL, arbors, clouds, points, table

from .morphometry import r
from .skeletons import WALK

# ------------------------------------------------------------------------ tangents
#: Eigenvalues of a symmetric 3x3 matrix by the trigonometric formula.
DOTS = f"""WITH {ARBORS_SQL}, nn AS (
  SELECT a.neuron_id, a.point_no, b.x, b.y, b.z FROM arbors a JOIN arbors b ON a.neuron_id = b.neuron_id
  QUALIFY row_number() OVER (PARTITION BY a.neuron_id, a.point_no ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, b.point_no) <= 20),
c AS (SELECT neuron_id, point_no, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM nn GROUP BY ALL),
q AS (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx+yy+zz)/3) ** 2 + (yy - (xx+yy+zz)/3) ** 2 + (zz - (xx+yy+zz)/3) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM c),
d AS (SELECT *, ((xx-q) * ((yy-q) * (zz-q) - yz * yz) - xy * (xy * (zz-q) - yz * xz) + xz * (xy * yz - (yy-q) * xz)) / (2 * p ** 3) AS r FROM q),
e AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3) AS e1, q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3) AS e3 FROM d),
f AS (SELECT *, 3 * q - e1 - e3 AS e2 FROM e)"""


@register("dot_properties", f"{DOTS} SELECT neuron_id, point_no AS dot_id, round((e1 - e2) / (e1 + e2 + e3), 3) AS alpha FROM f")
def dot_properties(spark, sf_dir):
    return sim.dot_properties(arbors(spark, sf_dir)).select("neuron_id", "dot_id", r(F.col("alpha"), 3).alias("alpha"))


@register("moved_dot_properties", f"{DOTS} SELECT neuron_id, point_no AS dot_id, round((e1 - e2) / (e1 + e2 + e3), 3) AS alpha FROM f")
def moved_dot_properties(spark, sf_dir):
    """A rotation and a shift leave alpha as it is."""
    from arborkit.operators import geometry as g

    moved = g.transform_points(arbors(spark, sf_dir), g.scale_rotate_translate(g.scaling(1, 1, 1), g.rotation(0, 0, 90, degrees=True), g.translation(3, 4, 5)))
    return sim.dot_properties(moved).select("neuron_id", "dot_id", r(F.col("alpha"), 3).alias("alpha"))


# --------------------------------------------------------------------------- pairs
#: Clouds of 21 dots with the direction to the next dot (the last one's from the dot before).
CL = """cl AS (SELECT vec_id AS neuron_id, dot_id::INTEGER AS dot_id, embedding[dot_id*3+1]::DOUBLE AS x, embedding[dot_id*3+2]::DOUBLE AS y, embedding[dot_id*3+3]::DOUBLE AS z
FROM (SELECT vec_id, embedding, unnest(range(0, 21)) AS dot_id FROM embeddings)),
st AS (SELECT *, coalesce(lead(x) OVER q - x, x - lag(x) OVER q) AS ux, coalesce(lead(y) OVER q - y, y - lag(y) OVER q) AS uy, coalesce(lead(z) OVER q - z, z - lag(z) OVER q) AS uz FROM cl WINDOW q AS (PARTITION BY neuron_id ORDER BY dot_id)),
dp AS (SELECT neuron_id, dot_id, x, y, z, ux, uy, uz, ux / sqrt(ux**2+uy**2+uz**2) AS vx, uy / sqrt(ux**2+uy**2+uz**2) AS vy, uz / sqrt(ux**2+uy**2+uz**2) AS vz FROM st)"""


def dotted(spark, sf_dir):
    w = Window.partitionBy("neuron_id").orderBy("dot_id")
    u = {f"u{a}": F.coalesce(F.lead(a).over(w) - F.col(a), F.col(a) - F.lag(a).over(w)) for a in "xyz"}
    rows = clouds(spark, sf_dir).withColumns(u)
    size = F.sqrt(sum((F.col(f"u{a}") ** 2 for a in "xyz"), F.lit(0.0)))
    return rows.withColumns({f"v{a}": F.col(f"u{a}") / size for a in "xyz"})


def _pairs(name, score, schema, sql, columns=("x", "y", "z", "vx", "vy", "vz"), both=False, digits=5):
    """All pairs of clouds; ``sql`` names aggregates over ``d`` (distance) and ``dot`` of each dot of b."""
    names = [x.split()[0] for x in schema.split(", ")]
    order = "<>" if both else "<"

    @register(name, f"""WITH {CL}, nn AS (SELECT a.neuron_id AS id_a, b.neuron_id AS id_b, b.dot_id, arg_min(a, ((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, a.dot_id)) AS a, any_value(b) AS b, sqrt(min((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) AS d
FROM dp a JOIN dp b ON a.neuron_id {order} b.neuron_id GROUP BY ALL),
t AS (SELECT *, abs(a.vx*b.vx + a.vy*b.vy + a.vz*b.vz) AS dot, exp(-(d**2) / (2*0.3**2)) AS g FROM nn)
SELECT id_a, id_b, {', '.join(f'round({sql[n]}, {digits}) AS {n}' for n in names)} FROM t GROUP BY id_a, id_b""")
    def run(spark, sf_dir):
        return sim.pairwise(sim.packed(dotted(spark, sf_dir), columns=columns), sim.rounded(score, digits), schema, both)

    return run


_pairs("pair_median_distance", sim.median_distance, "median double", {"median": "quantile_cont(d, 0.5)"}, ("x", "y", "z"), both=True)
_pairs("pair_weighted_distance", partial(sim.weighted_distance, sd=0.3), "score double", {"score": "avg(g) / (0.3 * sqrt(2 * pi()))"}, ("x", "y", "z"))
_LOW = "exp(-2.0)"
_pairs(
    "pair_scores", partial(sim.pair_scores, sd=0.3), "distance double, total double, score double, apart double, turned double",
    {"distance": "1 - avg(sqrt(g * dot))", "total": "sum(sqrt(g * dot))", "score": f"sum((g - {_LOW}) / (1 - {_LOW}) * dot)", "apart": "1 - avg(g)", "turned": "1 - avg(dot)"},
)
_LEN = "sqrt(b.ux**2 + b.uy**2 + b.uz**2)"
_pairs(
    "pair_lineset_mismatch", sim.lineset_mismatch, "mismatch double",
    {"mismatch": f"sum({_LEN} * d**2 + {_LEN}**3 / 6 * (1 - (a.ux*b.ux + a.uy*b.uy + a.uz*b.uz) / ({_LEN} * sqrt(a.ux**2 + a.uy**2 + a.uz**2))))"}, ("x", "y", "z", "ux", "uy", "uz"),
)


@register("pair_median_both_ways", f"""WITH {CL}, nn AS (SELECT a.neuron_id AS id_a, b.neuron_id AS id_b, b.dot_id, sqrt(min((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) AS d FROM dp a JOIN dp b ON a.neuron_id <> b.neuron_id GROUP BY ALL),
m AS (SELECT id_a, id_b, quantile_cont(d, 0.5) AS m FROM nn GROUP BY ALL) SELECT a.id_a, a.id_b, round((a.m + b.m) / 2, 5) AS median FROM m a JOIN m b ON a.id_a = b.id_b AND a.id_b = b.id_a WHERE a.id_a < a.id_b""")
def pair_median_both_ways(spark, sf_dir):
    return sim.pairwise(sim.packed(clouds(spark, sf_dir)), sim.rounded(partial(sim.median_distance, both=True), 5), "median double")


@register("pair_polyline_mismatch", f"""WITH {CL}, p AS (SELECT *, lead(x) OVER q - x AS dx, lead(y) OVER q - y AS dy, lead(z) OVER q - z AS dz FROM cl WINDOW q AS (PARTITION BY neuron_id ORDER BY dot_id)),
j AS (SELECT a.neuron_id AS id_a, b.neuron_id AS id_b, sqrt(a.dx**2+a.dy**2+a.dz**2) AS l, sqrt(b.dx**2+b.dy**2+b.dz**2) AS o, a.dx*b.dx + a.dy*b.dy + a.dz*b.dz AS dot, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS g FROM p a JOIN p b ON a.dot_id = b.dot_id AND a.neuron_id < b.neuron_id WHERE a.dx IS NOT NULL)
SELECT id_a, id_b, round(sum(l * g + l**3 / 6 * (1 - dot / (l * o))), 5) AS mismatch FROM j GROUP BY ALL""")
def pair_polyline_mismatch(spark, sf_dir):
    return sim.pairwise(sim.packed(clouds(spark, sf_dir)), sim.rounded(sim.polyline_mismatch_all, 5), "mismatch double")


@register("line_mismatch_by_index", f"""WITH {CL}, p AS (SELECT *, lead(x) OVER q - x AS dx, lead(y) OVER q - y AS dy, lead(z) OVER q - z AS dz FROM cl WINDOW q AS (PARTITION BY neuron_id ORDER BY dot_id))
SELECT neuron_id, round(sum(sqrt(dx**2+dy**2+dz**2) * (1 + 4 + 9)), 5) AS mismatch FROM p WHERE dx IS NOT NULL GROUP BY neuron_id""")
def line_mismatch_by_index(spark, sf_dir):
    """A line against itself moved by (1, 2, 3): no turn, a distance of sqrt(14) everywhere."""
    a = clouds(spark, sf_dir).withColumnRenamed("dot_id", "point_no")
    b = a.withColumns({"x": F.col("x") + 1, "y": F.col("y") + 2, "z": F.col("z") + 3})
    return s.line_mismatch(a, b).withColumn("mismatch", r(F.col("mismatch"), 5))


#: Points of each neuron's longest segment, numbered from 1, with their places along it.
LONGEST = f"""{WALK}, tot AS (SELECT neuron_id, tree_no, seg_no, sum(step) AS length FROM long GROUP BY ALL),
best AS (SELECT neuron_id, tree_no, seg_no FROM tot QUALIFY row_number() OVER (PARTITION BY neuron_id ORDER BY length DESC, tree_no, seg_no) = 1),
line AS MATERIALIZED (SELECT *, (pos + 1)::INTEGER AS i, count(*) OVER (PARTITION BY neuron_id) AS n FROM meas SEMI JOIN best USING (neuron_id, tree_no, seg_no))"""
#: Dynamic time warping, one anti-diagonal a step: a row knows its cell's total and that of the cell before it.
ALIGNED = f"""{LONGEST}, met AS (
  SELECT a.neuron_id AS id_a, b.neuron_id AS id_b, a.i, b.i AS j, a.n, b.n AS m, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d,
         row_number() OVER (PARTITION BY a.neuron_id, b.neuron_id, a.i ORDER BY (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, b.i) <= 10 AS near FROM line a JOIN line b ON a.neuron_id < b.neuron_id),
cell AS MATERIALIZED (SELECT id_a, id_b, i, j, n, m, CASE WHEN near THEN d ELSE max(d) FILTER (WHERE near) OVER (PARTITION BY id_a, id_b) END AS c FROM met),
front AS (
  SELECT id_a, id_b, i, 2 AS diagonal, c AS total, 1 AS steps, NULL::DOUBLE AS before, 0 AS steps_before FROM cell WHERE i = 1 AND j = 1
  UNION ALL
  SELECT id_a, id_b, i, diagonal, best.total, best.steps + 1, kept, kept_steps FROM (
    SELECT w.id_a, w.id_b, w.i, w.diagonal, min(struct_pack(total := w.t + w.weight * c.c, way := w.way, steps := w.s)) AS best, max(w.t) FILTER (WHERE w.way = 2) AS kept, max(w.s) FILTER (WHERE w.way = 2) AS kept_steps
    FROM (SELECT id_a, id_b, i, diagonal + 1 AS diagonal, 2 AS way, 1 AS weight, total AS t, steps AS s FROM front
          UNION ALL SELECT id_a, id_b, i + 1, diagonal + 1, 1, 1, total, steps FROM front
          UNION ALL SELECT id_a, id_b, i + 1, diagonal + 1, 0, 2, before, steps_before FROM front WHERE before IS NOT NULL) w
    JOIN cell c ON c.id_a = w.id_a AND c.id_b = w.id_b AND c.i = w.i AND c.j = w.diagonal - w.i GROUP BY ALL))
SELECT f.id_a, f.id_b, round(f.total / f.diagonal, 4) AS cost, f.steps::INTEGER AS steps FROM front f JOIN (SELECT DISTINCT id_a, id_b, n, m FROM cell) e ON e.id_a = f.id_a AND e.id_b = f.id_b AND f.i = e.n AND f.diagonal = e.n + e.m"""


@register("longest_segment_mismatch", f"""{LONGEST}, part AS (SELECT neuron_id, total, unnest(range(0, 11))::INTEGER AS p FROM line WHERE pos = 0),
stand AS (SELECT q.neuron_id, q.p, l.x + (p * q.total / 10 - s) / (s1 - s) * (x1 - x) AS x, l.y + (p * q.total / 10 - s) / (s1 - s) * (y1 - y) AS y, l.z + (p * q.total / 10 - s) / (s1 - s) * (z1 - z) AS z
  FROM part q JOIN line l USING (neuron_id) WHERE x1 IS NOT NULL AND p < 10 AND s <= p * q.total / 10 AND p * q.total / 10 < s1
  UNION ALL SELECT neuron_id, 10, x, y, z FROM line WHERE x1 IS NULL),
v AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM stand WINDOW w AS (PARTITION BY neuron_id ORDER BY p)),
j AS (SELECT a.neuron_id AS id_a, b.neuron_id AS id_b, sqrt(a.dx**2+a.dy**2+a.dz**2) AS l, sqrt(b.dx**2+b.dy**2+b.dz**2) AS o, a.dx*b.dx + a.dy*b.dy + a.dz*b.dz AS dot, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS g FROM v a JOIN v b ON a.p = b.p AND a.neuron_id < b.neuron_id WHERE a.dx IS NOT NULL)
SELECT id_a, id_b, round(sum(l * g + l**3 / 6 * (1 - dot / (l * o))), 3) AS mismatch FROM j GROUP BY ALL""")
def longest_segment_mismatch(spark, sf_dir):
    points_ = arbors(spark, sf_dir)
    longest = k.longest_segment(k.segment_list(points_), points_)
    return sim.longest_segment_mismatch(sim.packed(longest, "pos"), digits=3)


@register("alignments", ALIGNED)
def alignments(spark, sf_dir):
    points_ = arbors(spark, sf_dir)
    longest = k.longest_segment(k.segment_list(points_), points_)
    return sim.pairwise(sim.packed(longest, "pos"), sim.aligned_all, "cost double, steps int").withColumn("cost", r(F.col("cost")))


@register("step_strings_matched")
def step_strings_matched(spark, sf_dir):
    points_ = arbors(spark, sf_dir)
    longest = k.longest_segment(k.segment_list(points_), points_)
    out = sim.pairwise(sim.packed(longest, "pos"), partial(sim.chunks_matched_all, delta=10.0), "cost double, mutated int, inserted int, deleted int", prepare=partial(sim.steps_of, delta=10.0))
    return out.withColumn("cost", r(F.col("cost")))


@register("segments_aligned")
def segments_aligned(spark, sf_dir):
    """Every segment of more than one step with every other one of the same neuron's first two segment orders."""
    points_ = arbors(spark, sf_dir)
    segments = k.segment_list(points_).where("tree_no = 1 and seg_order <= 2")
    rows = k.with_places(segments, points_).withColumn("neuron_id", F.col("neuron_id") * 1_000_000 + F.col("seg_no"))
    return sim.pairwise(sim.packed(rows, "pos"), sim.aligned_all, "cost double, steps int").withColumn("cost", r(F.col("cost")))


@register("nearest_to_place", f"""WITH {ARBORS_SQL}, d AS (SELECT neuron_id, point_no AS dot_id, sqrt((x-25)**2 + (y-50)**2 + (z-5)**2) AS distance FROM arbors)
SELECT neuron_id, row_number() OVER (PARTITION BY neuron_id ORDER BY distance, dot_id)::INTEGER AS rank, dot_id, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY neuron_id ORDER BY distance, dot_id) <= 3""")
def nearest_to_place(spark, sf_dir):
    dots = arbors(spark, sf_dir).withColumnRenamed("point_no", "dot_id")
    return sim.nearest_to(dots, (25.0, 50.0, 5.0), 3).select("neuron_id", "rank", "dot_id", r(F.col("distance"), 5).alias("distance"))


# ------------------------------------------------------------------ synapses, planes
@register("expected_synapses", f"""WITH {POINTS_SQL}, p AS (SELECT neuron_id, (x0+x1)/2 AS x, (y0+y1)/2 AS y, (z0+z1)/2 AS z, len AS l, x1-x0 AS dx, y1-y0 AS dy, z1-z0 AS dz FROM seglets WHERE len > 0),
j AS (SELECT a.neuron_id AS neuron_a, b.neuron_id AS neuron_b, a.l * b.l * acos(greatest(-1.0, least(1.0, (a.dx*b.dx+a.dy*b.dy+a.dz*b.dz) / (a.l * b.l)))) * exp(-((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) / 0.04) / (0.04 * pi()) ** 1.5 AS t FROM p a JOIN p b ON b.y BETWEEN a.y - 1 AND a.y + 1 WHERE a.neuron_id < b.neuron_id AND (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 1)
SELECT neuron_a, neuron_b, round(0.1 * sum(t), 2) AS expected FROM j GROUP BY ALL""")
def expected_synapses(spark, sf_dir):
    """All pairs of neurons with middles of segments within ten sigma."""
    p = s.seglets(points(spark, sf_dir))
    return m.potential_synapses(p, p, 0.05, "expected", 0.1, 2)


@register("line_plane_crossings", f"""WITH {POINTS_SQL} SELECT neuron_id, point_no, round(x0 + u * (x1 - x0), 3) AS x, round(y0 + u * (y1 - y0), 3) AS y, round(z0 + u * (z1 - z0), 3) AS z FROM (SELECT *, (x0 + y0 - 40) / ((x0 - x1) + (y0 - y1)) AS u FROM seglets WHERE abs((x0 - x1) + (y0 - y1)) > 1)""")
def line_plane_crossings(spark, sf_dir):
    from arborkit.operators import geometry as g

    rows = s.seglets(points(spark, sf_dir)).where("abs((x0 - x1) + (y0 - y1)) > 1")
    return g.intersect_line_with_plane(rows, (1.0, 1.0, 0.0, -40.0)).select("neuron_id", "point_no", *[r(F.col(c), 3).alias(c) for c in "xyz"])


@register("closest_plane_crossing", f"""WITH {POINTS_SQL}, u AS (SELECT *, (x0 - 25) / nullif(x0 - x1, 0) AS u FROM seglets), h AS (SELECT neuron_id, point_no, x0 + u*(x1-x0) AS x, y0 + u*(y1-y0) AS y, z0 + u*(z1-z0) AS z FROM u WHERE u BETWEEN 0 AND 1)
SELECT neuron_id, point_no FROM h QUALIFY row_number() OVER (PARTITION BY neuron_id ORDER BY round((x-25)**2 + (y-40)**2 + (z-5)**2, 6), point_no) = 1""")
def closest_plane_crossing(spark, sf_dir):
    from arborkit.operators import geometry as g

    hits = g.intersect_segment_with_plane(s.seglets(points(spark, sf_dir)), (1.0, 0.0, 0.0, -25.0))
    return g.closest_crossing(hits, (25.0, 40.0, 5.0)).select("neuron_id", "point_no")


@register("line_pairs", f"WITH {ARBORS_SQL} SELECT neuron_id, pos, point_no FROM (SELECT neuron_id, point_no, generate_series AS pos FROM (SELECT neuron_id, point_no, count(*) OVER (PARTITION BY neuron_id) AS n FROM arbors), LATERAL (SELECT unnest(CASE WHEN point_no = 1 THEN [0] WHEN point_no = n THEN [2 * n - 3] ELSE [2 * point_no - 3, 2 * point_no - 2] END) AS generate_series))")
def line_pairs(spark, sf_dir):
    rows = arbors(spark, sf_dir)
    return s.line_pairs(rows).select("neuron_id", "pos", "point_no")


# ------------------------------------------------------------------ distance tables
DIST = "dist AS (SELECT l_partkey % 60 AS a, l_suppkey % 60 AS b, avg(l_quantity) AS d FROM lineitem WHERE l_partkey % 60 <> l_suppkey % 60 GROUP BY ALL), sym AS (SELECT least(a, b) AS a, greatest(a, b) AS b, avg(d) AS d FROM dist GROUP BY 1, 2)"


def distances(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("a"), (F.col("l_suppkey") % 60).alias("b"), F.col("l_quantity").alias("d")).where("a <> b")
    return m.symmetrise(rows.groupBy("a", "b").agg(F.avg("d").alias("d")))


def _symmetrised(how, sql):
    @register(f"symmetrise_{how}", f"WITH {DIST} SELECT least(a, b) AS a, greatest(a, b) AS b, round({sql}(d), 4) AS d FROM dist GROUP BY 1, 2")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("a"), (F.col("l_suppkey") % 60).alias("b"), F.col("l_quantity").alias("d")).where("a <> b")
        return m.symmetrise(rows.groupBy("a", "b").agg(F.avg("d").alias("d")), how).withColumn("d", r(F.col("d")))


for _how in ("min", "max"):
    _symmetrised(_how, _how)


@register("distance_subset", f"WITH {DIST} SELECT a, b, round(d, 4) AS d FROM sym WHERE a % 3 = 0 AND b % 3 = 0")
def distance_subset(spark, sf_dir):
    d = distances(spark, sf_dir)
    kept = table(spark, sf_dir, "nation").select((F.explode(F.sequence(F.lit(0), F.lit(59), F.lit(3)))).alias("id")).distinct()
    return m.subset(d, kept).withColumn("d", r(F.col("d")))


@register("distances_matched", f"WITH {DIST}, o AS (SELECT l_partkey % 40 AS a, l_partkey % 7 AS b, avg(l_tax) AS d FROM lineitem WHERE l_partkey % 40 <> l_partkey % 7 GROUP BY ALL), os AS (SELECT least(a, b) AS a, greatest(a, b) AS b, avg(d) AS d FROM o GROUP BY 1, 2) SELECT sym.a, sym.b, round(sym.d, 4) AS d1, round(os.d, 6) AS d2 FROM sym JOIN os USING (a, b)")
def distances_matched(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("a"), (F.col("l_partkey") % 7).alias("b"), F.col("l_tax").alias("d")).where("a <> b")
    other = m.symmetrise(rows.groupBy("a", "b").agg(F.avg("d").alias("d")))
    out = m.matched_distances(distances(spark, sf_dir), other)
    return out.select("a", "b", r(F.col("d1")).alias("d1"), r(F.col("d2"), 6).alias("d2"))


@register("distances_renamed_at_random", f"WITH {DIST} SELECT count(*)::BIGINT AS n, round(sum(d), 3) AS total, true AS permuted FROM sym")
def distances_renamed_at_random(spark, sf_dir):
    d = distances(spark, sf_dir)
    out = m.randomise(d, 5)
    moved = out.join(d.select("a", "b", F.col("d").alias("before")), ["a", "b"], "left").agg(F.count("*").alias("n"), r(F.sum("d"), 3).alias("total"), F.max(F.coalesce(F.col("d") != F.col("before"), F.lit(True))).alias("permuted"))
    return moved


@register("mantel_correlation")
def mantel_correlation(spark, sf_dir):
    d = distances(spark, sf_dir)
    return m.mantel(d, d.withColumn("d", F.col("d") * 2 + 1), 20, 3)


@register("ward_clusters")
def ward_clusters(spark, sf_dir):
    from arborkit.operators import clustering

    out = sim.pairwise(sim.packed(clouds(spark, sf_dir)), partial(sim.median_distance, both=True), "d double")
    return clustering.clusters(out.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "d"), 4)


#: Squared distance of two segments: the ends against the other segment, and the lines' closest points if inside both.
def _held(x):
    return f"least(1.0, greatest(0.0, coalesce({x}, 0.0)))"


def _gap(s, t):
    return f"(ww + ({s}) * ({s}) * uu + ({t}) * ({t}) * vv + 2 * ({s}) * uw - 2 * ({t}) * vw - 2 * ({s}) * ({t}) * uv)"


_UV = ", ".join(f"a.{c}1 - a.{c}0 AS u{c}, b.{c}1 - b.{c}0 AS v{c}, a.{c}0 - b.{c}0 AS w{c}" for c in "xyz")
_DOT = ", ".join(f"u.{a}x*u.{b}x + u.{a}y*u.{b}y + u.{a}z*u.{b}z AS {a}{b}" for a, b in ("uu", "vv", "uv", "uw", "vw", "ww"))
_ENDS = [_gap(0.0, _held("vw / nullif(vv, 0)")), _gap(1.0, _held("(vw + uv) / nullif(vv, 0)")), _gap(_held("(-uw) / nullif(uu, 0)"), 0.0), _gap(_held("(uv - uw) / nullif(uu, 0)"), 1.0)]
_S, _T = "(uv * vw - vv * uw) / nullif(uu * vv - uv * uv, 0)", "(uu * vw - uv * uw) / nullif(uu * vv - uv * uv, 0)"
_INSIDE = f"CASE WHEN uu * vv - uv * uv > 1e-12 * uu * vv AND {_S} BETWEEN 0 AND 1 AND {_T} BETWEEN 0 AND 1 THEN {_gap(_S, _T)} END"
BOUNDED = f"""WITH {POINTS_SQL}, box AS (SELECT * FROM seglets WHERE x0 BETWEEN 10 AND 20 AND y0 BETWEEN 20 AND 40 AND z0 BETWEEN 2 AND 6),
u AS (SELECT a.neuron_id AS neuron_a, b.neuron_id AS neuron_b, {_UV} FROM box a JOIN box b ON a.neuron_id < b.neuron_id), k AS (SELECT neuron_a, neuron_b, {_DOT} FROM u),
g AS (SELECT neuron_a, neuron_b, sqrt(greatest(0, least({', '.join(_ENDS)}, coalesce({_INSIDE}, 1e18)))) AS d FROM k)"""


def _box(spark, sf_dir):
    from arborkit.operators import geometry as g

    return g.restrict_to_bounds(s.seglets(points(spark, sf_dir)), {"x": (10, 20), "y": (20, 40), "z": (2, 6)}, suffix="0")


@register("synapses_in_bounds", f"{BOUNDED} SELECT neuron_a, neuron_b, count(*)::BIGINT AS n FROM g WHERE d <= 0.501 GROUP BY ALL")
def synapses_in_bounds(spark, sf_dir):
    """Contacts of segments whose heads lie in a box, of any length."""
    box = _box(spark, sf_dir)
    return m.potential_synapses(box, box, 0.501, "direct", None)


@register("expected_synapses_in_bounds", f"""WITH {POINTS_SQL}, box AS (SELECT * FROM seglets WHERE len > 0 AND x0 BETWEEN 10 AND 20 AND y0 BETWEEN 20 AND 40 AND z0 BETWEEN 2 AND 6),
p AS (SELECT neuron_id, (x0+x1)/2 AS x, (y0+y1)/2 AS y, (z0+z1)/2 AS z, len AS l, x1-x0 AS dx, y1-y0 AS dy, z1-z0 AS dz FROM box),
j AS (SELECT a.neuron_id AS neuron_a, b.neuron_id AS neuron_b, a.l * b.l * acos(greatest(-1.0, least(1.0, (a.dx*b.dx+a.dy*b.dy+a.dz*b.dz) / (a.l * b.l)))) * exp(-((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) / 16) / (16 * pi()) ** 1.5 AS t, (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 AS r2 FROM p a JOIN p b ON a.neuron_id < b.neuron_id)
SELECT neuron_a, neuron_b, round(4 * sum(t), 3) AS expected FROM j WHERE r2 <= 400 GROUP BY ALL""")
def expected_synapses_in_bounds(spark, sf_dir):
    """Expected contacts of segments in a box whose middles lie within ten sigma."""
    box = _box(spark, sf_dir)
    return m.potential_synapses(box, box, 2.0, "expected", 2.0, 3)


@register("step_vectors", f"{WALK} SELECT neuron_id, tree_no, seg_no, pos, round(x1 - x, 5) AS dx, round(y1 - y, 5) AS dy, round(z1 - z, 5) AS dz FROM piece WHERE x1 IS NOT NULL")
def step_vectors(spark, sf_dir):
    p = arbors(spark, sf_dir)
    rows = k.start_end_list(k.segment_list(p), p)
    return rows.select("neuron_id", "tree_no", "seg_no", "pos", *[r(F.col(a + "1") - F.col(a + "0"), 5).alias("d" + a) for a in "xyz"])
