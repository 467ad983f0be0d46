"""Registered queries on voxel densities, statistics and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborkit.catalog import register
from arborkit.operators import density as d
from arborkit.operators import matching as m
from arborkit.operators import neighbours
from arborkit.operators import segments as s
from arborkit.operators import stats
from arborkit.sources.adapters import POINTS_SQL, clouds, points, table

from .morphometry import r

GRID = d.Grid((10, 12, 8), (0.0, 0.0, 0.0), (51.0, 108.0, 11.2))
CELL = "least(floor({c} / ({high} / {n}))::INTEGER, {n} - 1) AS {v}"
AT = ", ".join(CELL.format(c=c, v=v, high=h, n=n) for c, v, h, n in zip("xyz", "ijk", GRID.high, GRID.n))
VOX = f"""WITH {POINTS_SQL}, vox AS (
SELECT density_id, i, j, k, count(*)::BIGINT AS value FROM (
  SELECT region AS density_id, {AT} FROM points WHERE x >= 0 AND x < 51 AND y >= 0 AND y < 108 AND z >= 0 AND z < 11.2) GROUP BY ALL)"""
BY = ["density_id"]


def gauss_sql(sigma: float, sds: float, source: str = "vox") -> str:
    """Three common tables, the last named gz, that smooth ``source`` axis by axis."""
    import math

    reach = max(1, math.ceil(sds * max(math.ceil(sigma / v) for v in GRID.voxel)))
    sql, before = "", source
    for axis, v, n, size in zip("xyz", "ijk", GRID.n, GRID.voxel):
        weights = {o: math.exp(-((o * size) ** 2) / (2 * sigma**2)) for o in range(-reach, reach + 1)}
        taps = ", ".join(f"({o}, {w / sum(weights.values())!r})" for o, w in weights.items())
        rest = ", ".join(c for c in "ijk" if c != v)
        sql += f", g{axis} AS (SELECT density_id, {rest}, {v} + o AS {v}, sum(value * w) AS value FROM {before}, (VALUES {taps}) t(o, w) WHERE {v} + o BETWEEN 0 AND {n - 1} GROUP BY ALL)"
        before = f"g{axis}"
    return sql


def voxels(spark, sf_dir):
    return d.bin3d(points(spark, sf_dir).withColumnRenamed("region", "density_id"), GRID, BY)


@register("bin3d", f"{VOX} SELECT * FROM vox")
def bin3d(spark, sf_dir):
    return voxels(spark, sf_dir)


@register("integrate_density", f"{VOX} SELECT density_id, round(sum(value) * {5.1 * 9.0 * 1.4!r}, 3) AS integral FROM vox GROUP BY density_id")
def integrate_density(spark, sf_dir):
    return d.integrate(voxels(spark, sf_dir), GRID, BY).select("density_id", r(F.col("integral"), 3).alias("integral"))


@register("cumulative_threshold", f"""{VOX}, l AS (SELECT density_id, value, sum(value) AS mass FROM vox GROUP BY ALL),
c AS (SELECT *, sum(mass) OVER (PARTITION BY density_id ORDER BY value DESC) AS cum, sum(mass) OVER (PARTITION BY density_id) AS total FROM l)
SELECT density_id, max(value) AS threshold FROM c WHERE cum >= 0.8 * total GROUP BY density_id""")
def cumulative_threshold(spark, sf_dir):
    return d.cumulative_threshold(voxels(spark, sf_dir), 0.8, BY)


BOX = "box AS (SELECT density_id, min(i) AS i_min, max(i) AS i_max, min(j) AS j_min, max(j) AS j_max, min(k) AS k_min, max(k) AS k_max FROM vox WHERE value > 3 GROUP BY density_id)"


@register("min_bounding_box", f"{VOX}, {BOX} SELECT * FROM box")
def min_bounding_box(spark, sf_dir):
    return d.bounding_box(voxels(spark, sf_dir), 3, BY)


@register("crop_volume", f"{VOX}, {BOX} SELECT density_id, i - i_min AS i, j - j_min AS j, k - k_min AS k, value FROM vox JOIN box USING (density_id) WHERE i BETWEEN i_min AND i_max AND j BETWEEN j_min AND j_max AND k BETWEEN k_min AND k_max")
def crop_volume(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return d.crop(v, d.bounding_box(v, 3, BY), BY)


@register("blend_densities", f"{VOX}, w(output, density_id, weight) AS (VALUES ('p', 'A', 0.5), ('p', 'N', 0.25), ('q', 'R', 2.0), ('q', 'N', 1.0)) SELECT output, i, j, k, round(sum(value * weight), 4)::DOUBLE AS value FROM vox JOIN w USING (density_id) GROUP BY ALL")
def blend_densities(spark, sf_dir):
    weights = spark.createDataFrame([("p", "A", 0.5), ("p", "N", 0.25), ("q", "R", 2.0), ("q", "N", 1.0)], "output string, density_id string, weight double")
    return d.blend(voxels(spark, sf_dir), weights).withColumn("value", r(F.col("value")))


def _projection(name: str, measure: str, sql: str):
    @register(f"project_{name}", f"{VOX} SELECT density_id, i, j, round({sql}, 4)::DOUBLE AS value FROM vox GROUP BY ALL")
    def run(spark, sf_dir):
        out = d.project(voxels(spark, sf_dir), "k", measure, BY)
        return out.withColumn("value", r(F.col("value").cast("double")))

    return run


for _name, _sql in {"min": "min(value)", "max": "max(value)", "mean": "avg(value)", "sum": "sum(value)", "median": "quantile_cont(value, 0.5)", "variance": "var_pop(value)", "sd": "stddev_pop(value)", "l1": "sum(abs(value))", "l2": "sqrt(sum(value ** 2))", "linf": "max(abs(value))", "count": "count(value)"}.items():
    _projection(_name, _name, _sql)


def _combination(name: str, operation: str, sql: str):
    @register(f"combine_{name}", f"""{VOX}, a AS (SELECT i, j, k, value FROM vox WHERE density_id = 'A'), b AS (SELECT i, j, k, value FROM vox WHERE density_id = 'N'),
p AS (SELECT i, j, k, coalesce(a.value, 0)::DOUBLE AS x, coalesce(b.value, 0)::DOUBLE AS y FROM a FULL JOIN b USING (i, j, k)) SELECT i, j, k, round({sql}, 4) AS value FROM p""")
    def run(spark, sf_dir):
        v = voxels(spark, sf_dir)
        return d.combine(v.where("density_id = 'A'"), v.where("density_id = 'N'"), operation, d.VOXEL).withColumn("value", r(F.col("value")))

    return run


for _name, (_op, _sql) in {"max": ("max", "greatest(x, y)"), "min": ("min", "least(x, y)"), "add": ("+", "x + y"), "subtract": ("-", "x - y"), "multiply": ("*", "x * y"), "divide": ("/", "x / nullif(y, 0)")}.items():
    _combination(_name, _op, _sql)


@register("volumes_folded", f"{VOX} SELECT i, j, k, max(value)::DOUBLE AS greatest, min(value)::DOUBLE AS least, sum(value)::DOUBLE AS total, product(value)::DOUBLE AS product FROM vox GROUP BY ALL")
def volumes_folded(spark, sf_dir):
    """All volumes in one: the voxels that any has, folded four ways in one aggregation."""
    v = voxels(spark, sf_dir)
    return v.groupBy(*d.VOXEL).agg(F.max("value").cast("double").alias("greatest"), F.min("value").cast("double").alias("least"), F.sum("value").cast("double").alias("total"), F.product("value").alias("product"))


@register("flip_volume", f"{VOX} SELECT density_id, 9 - i AS i, j, k, value FROM vox")
def flip_volume(spark, sf_dir):
    return d.flip(voxels(spark, sf_dir), "i", 10)


@register("quantize_volume", f"{VOX} SELECT density_id, i, j, k, floor(greatest(0.0, least(20.0, value)) / 20.0 * 255 + 0.5)::BIGINT AS value FROM vox")
def quantize_volume(spark, sf_dir):
    return d.quantize(voxels(spark, sf_dir), 0.0, 20.0)


PAIRED = f"{VOX}, pairs AS (SELECT 1 AS pair, coalesce(a.value, 0)::DOUBLE AS a, coalesce(b.value, 0)::DOUBLE AS b FROM (SELECT * FROM vox WHERE density_id = 'A') a FULL JOIN (SELECT * FROM vox WHERE density_id = 'N') b USING (i, j, k))"


@register("mutual_information", f"""{PAIRED}, sp AS (SELECT pair, least(min(a), min(b)) AS low, greatest(max(a), max(b)) AS high FROM pairs GROUP BY pair),
q AS (SELECT pair, ceil((a - low) / ((high - low) / 99)) AS ba, ceil((b - low) / ((high - low) / 99)) AS bb FROM pairs JOIN sp USING (pair) WHERE a > low AND b > low),
n AS (SELECT count(*) AS n FROM q), e AS (SELECT
(SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*)::DOUBLE AS c FROM q GROUP BY ba), n) AS ha,
(SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*)::DOUBLE AS c FROM q GROUP BY bb), n) AS hb,
(SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*)::DOUBLE AS c FROM q GROUP BY ba, bb), n) AS hab)
SELECT 1 AS pair, round(ha, 4) AS ha, round(hb, 4) AS hb, round(hab, 4) AS hab, round(ha + hb - hab, 4) AS mi, round((ha + hb) / hab, 4) AS nmi, round(2 / ((ha + hb) / hab) - 1, 4) AS mi_distance FROM e""")
def mutual_information(spark, sf_dir):
    v = voxels(spark, sf_dir)
    a, b = (v.where(F.col("density_id") == x).select(*d.VOXEL, F.col("value").cast("double").alias(n)) for x, n in (("A", "a"), ("N", "b")))
    pairs = a.join(b, d.VOXEL, "full").select(F.lit(1).alias("pair"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    out = stats.mutual_information(stats.entropies(pairs))
    return out.select("pair", *[r(F.col(c)).alias(c) for c in ("ha", "hb", "hab", "mi", "nmi", "mi_distance")])


@register("pooled_t_map", """WITH e AS (SELECT hour(ts) AS voxel, user_id % 2 = 1 AS one, value FROM events WHERE value IS NOT NULL),
g AS (SELECT voxel, count(*) FILTER (WHERE one) AS n1, count(*) FILTER (WHERE NOT one) AS n2, avg(value) FILTER (WHERE one) AS m1, avg(value) FILTER (WHERE NOT one) AS m2,
var_samp(value) FILTER (WHERE one) AS v1, var_samp(value) FILTER (WHERE NOT one) AS v2 FROM e GROUP BY voxel)
SELECT voxel::INTEGER AS voxel, n1::BIGINT AS n1, n2::BIGINT AS n2, round((m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2)/(n1+n2-2) * (1.0/n1 + 1.0/n2)), 4) AS t FROM g WHERE n1 > 1 AND n2 > 1""")
def pooled_t_map(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select(F.hour("ts").alias("voxel"), (F.col("user_id") % 2 == 1).alias("one"), "value")
    return stats.pooled_t(e, ["voxel"], "one", "value").withColumn("t", r(F.col("t")))


@register("permutation_extremes", """WITH e AS (SELECT hour(ts)::INTEGER AS voxel, user_id, value FROM events WHERE value IS NOT NULL), u AS (SELECT DISTINCT user_id FROM e), n1 AS (SELECT count(*) // 2 AS n FROM u),
l AS (SELECT user_id, perm::INTEGER AS perm, row_number() OVER (PARTITION BY perm ORDER BY md5(concat(user_id, ':', perm, ':11')), user_id) <= (SELECT n FROM n1) AS one FROM u, range(1, 6) p(perm)),
g AS (SELECT perm, voxel, count(*) FILTER (WHERE one) AS n1, count(*) FILTER (WHERE NOT one) AS n2, avg(value) FILTER (WHERE one) AS m1, avg(value) FILTER (WHERE NOT one) AS m2, var_samp(value) FILTER (WHERE one) AS v1, var_samp(value) FILTER (WHERE NOT one) AS v2 FROM e JOIN l USING (user_id) GROUP BY ALL),
t AS (SELECT perm, (m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2)/(n1+n2-2) * (1.0/n1 + 1.0/n2)) AS t FROM g WHERE n1 > 1 AND n2 > 1)
SELECT perm, q, round(quantile_cont(t, [0, 0.001, 0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99, 0.999, 1])[q + 1], 4) AS value FROM t, range(11) r(q) GROUP BY perm, q""")
def permutation_extremes(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select(F.hour("ts").alias("voxel"), "user_id", "value")
    out = stats.permutation_extremes(e, ["voxel"], "user_id", "value", 5, 11)
    return out.select("perm", F.posexplode("quantiles").alias("q", "value")).withColumn("value", r(F.col("value")))


@register("value_histogram", """WITH b AS (SELECT event_type, least(floor(value / (100.0 / 50)), 49)::INTEGER AS bin FROM events WHERE value BETWEEN 0 AND 100),
c AS (SELECT event_type, bin, count(*)::BIGINT AS count FROM b GROUP BY ALL), q AS (SELECT *, count / sum(count) OVER (PARTITION BY event_type) AS density FROM c)
SELECT event_type, bin, count, round(density, 6) AS density, round(sum(density) OVER (PARTITION BY event_type ORDER BY bin), 6) AS cdf FROM q""")
def value_histogram(spark, sf_dir):
    h = stats.cumulative(stats.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 100.0, 50), ["event_type"])
    return h.select("event_type", "bin", "count", r(F.col("density"), 6).alias("density"), r(F.col("cdf"), 6).alias("cdf"))


@register("value_quantiles", "SELECT event_type, round(quantile_cont(value, 0.1), 4) AS q10, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.9), 4) AS q90 FROM events GROUP BY event_type")
def value_quantiles(spark, sf_dir):
    return stats.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.1, 0.5, 0.9]).select("event_type", *[r(F.col(c)).alias(c) for c in ("q10", "q50", "q90")])


CLOUDS = """WITH cl AS (SELECT vec_id AS neuron_id, dot_id::INTEGER AS dot_id, embedding[dot_id*3+1]::DOUBLE AS x, embedding[dot_id*3+2]::DOUBLE AS y, embedding[dot_id*3+3]::DOUBLE AS z
FROM (SELECT vec_id, embedding, unnest(range(0, 21)) AS dot_id FROM embeddings)),
pr AS (SELECT a.vec_id AS query_id, b.target_id FROM embeddings a JOIN (SELECT min(vec_id) AS target_id FROM embeddings GROUP BY label) b ON a.vec_id <> b.target_id),
nn AS (SELECT query_id, target_id, q.dot_id AS q_dot, min(sqrt((q.x-t.x)**2 + (q.y-t.y)**2 + (q.z-t.z)**2)) AS distance
FROM pr JOIN cl q ON q.neuron_id = query_id JOIN cl t ON t.neuron_id = target_id GROUP BY ALL)"""


def _nearest(spark, sf_dir):
    """Every cloud against the first cloud of each label."""
    c = clouds(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("target_id")).select("target_id")
    pairs = e.select(F.col("vec_id").alias("query_id")).crossJoin(F.broadcast(first)).where("query_id <> target_id")
    return neighbours.nearest_points(c, c, pairs)


@register("nearest_points", f"{CLOUDS} SELECT query_id, target_id, q_dot, round(distance, 5) AS distance FROM nn")
def nearest_points(spark, sf_dir):
    return _nearest(spark, sf_dir).select("query_id", "target_id", "q_dot", r(F.col("distance"), 5).alias("distance"))


@register("neighbour_score", f"{CLOUDS} SELECT query_id, target_id, round(avg(exp(-(distance ** 2) / (2 * 0.25)) / (0.5 * sqrt(2 * pi()))), 5) AS score FROM nn GROUP BY ALL")
def neighbour_score(spark, sf_dir):
    return m.neighbour_score(_nearest(spark, sf_dir), 0.5).withColumn("score", r(F.col("score"), 5))


@register("median_min_distance", f"{CLOUDS} SELECT query_id, target_id, round(quantile_cont(distance, 0.5), 5) AS median FROM nn GROUP BY ALL")
def median_min_distance(spark, sf_dir):
    return m.median_min_distance(_nearest(spark, sf_dir)).withColumn("median", r(F.col("median"), 5))


@register("symmetrise_distances", """WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, l_quantity AS d FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(avg(d), 4) AS d FROM e GROUP BY 1, 2""")
def symmetrise_distances(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("d"))
    return m.symmetrise(rows).withColumn("d", r(F.col("d")))


@register("rank_correlation", """WITH v AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem),
k AS (SELECT (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2) AS rx, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2) AS ry FROM v)
SELECT round(corr(rx, ry), 6) AS rho FROM k""")
def rank_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return m.spearman(rows, "x", "y").select(r(F.col("rho"), 6).alias("rho"))


@register("direct_synapses")
def direct_synapses(spark, sf_dir):
    pieces = s.seglets(points(spark, sf_dir))
    return m.direct_synapses(pieces, pieces, 0.05, None)


@register("prefix_match", """WITH k AS (SELECT DISTINCT left(n_name, 4) AS key FROM nation), h AS (SELECT key, n_name FROM k LEFT JOIN nation ON starts_with(upper(n_name), upper(key)))
SELECT key, coalesce(max(CASE WHEN upper(n_name) = upper(key) THEN n_name END), CASE WHEN count(DISTINCT n_name) = 1 THEN max(n_name) END) AS matched FROM h GROUP BY key""")
def prefix_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name")
    return m.prefix_match(n.select(F.substring("n_name", 1, 4).alias("key")).distinct(), "key", n, "n_name")


@register("gaussian_smooth", f"{VOX}{gauss_sql(3.0, 4.0)} SELECT density_id, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, round(value, 6) AS value FROM gz")
def gaussian_smooth(spark, sf_dir):
    return d.gaussian_smooth(voxels(spark, sf_dir), GRID, 3.0, by=BY).withColumn("value", r(F.col("value"), 6))
