"""Registered queries on grids, resampling, image statistics, fits, hulls, planes and warps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborkit.catalog import register
from arborkit.operators import density as d
from arborkit.operators import geometry as g
from arborkit.operators import images as im
from arborkit.operators import registration as reg
from arborkit.operators import regions as rg
from arborkit.operators import stats
from arborkit.sources.adapters import ARBORS_SQL, BOXES_SQL, arbors, boxed, clouds, points, table

from .files import DENSE
from .morphometry import r
from .volumes import BY, GRID, VOX, gauss_sql, voxels

TARGET = im.grid_of([20, 12, 8, 2.55, 9.0, 1.4, 1.275, 4.5, 0.7])
CENTRES = [l + v / 2 for l, v in zip(GRID.low, GRID.voxel)]
DX, DY, DZ = GRID.voxel


# ---------------------------------------------------------------------------- grids
_AT = {v: f"range(200) {v}_({v})" for v in "ijk"}


def _grid_sql(place: str, counts: str = "{v} < n_{a}") -> str:
    """Every index triple of each neuron's grid, with ``place`` of each axis."""
    where = " AND ".join(counts.format(a=a, v=v) for a, v in zip("xyz", "ijk"))
    return f"WITH {BOXES_SQL} SELECT neuron_id, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, {', '.join(f'round({place.format(a=a, v=v)}, 9) AS {a}' for a, v in zip('xyz', 'ijk'))} FROM box, {', '.join(_AT.values())} WHERE {where}"


def _rounded(rows):
    return rows.select("neuron_id", "i", "j", "k", *[r(F.col(c), 9).alias(c) for c in "xyz"])


@register("grids_checked", f"WITH {BOXES_SQL} SELECT neuron_id, neuron_id % 4 <> 0 AND high_x > low_x AND high_y > low_y AND high_z > low_z AS is_grid FROM box")
def grids_checked(spark, sf_dir):
    """Which rows describe a density's grid; every fourth lacks a bound."""
    rows = boxed(spark, sf_dir).withColumn("high_z", F.when(F.col("neuron_id") % 4 != 0, F.col("high_z")))
    return rows.select("neuron_id", im.is_grid().alias("is_grid"))


@register("voxel_centres", _grid_sql("low_{a} + ({v} + 0.5) * (high_{a} - low_{a}) / n_{a}"))
def voxel_centres(spark, sf_dir):
    return _rounded(im.centres(boxed(spark, sf_dir), ["neuron_id"]))


_FITS = "low_{a} + {shift} + {v} * 7.0 <= high_{a} + 7e-9"


@register("regular_grid", _grid_sql("low_{a} + 3.5 + {v} * 7.0", _FITS.replace("{shift}", "3.5")))
def regular_grid(spark, sf_dir):
    return _rounded(im.regular_points(boxed(spark, sf_dir), ["neuron_id"], 7.0))


@register("grid_margins", _grid_sql("low_{a} + {v} * 7.0", _FITS.replace("{shift}", "0")))
def grid_margins(spark, sf_dir):
    return _rounded(im.regular_points(boxed(spark, sf_dir), ["neuron_id"], 7.0, margins=True))


@register("cubic_mesh", _grid_sql("low_{a} + {v} * (high_{a} - low_{a}) / (n_{a} - 1)"))
def cubic_mesh(spark, sf_dir):
    return _rounded(im.meshes(boxed(spark, sf_dir), ["neuron_id"]))


@register("vector_as_cube", "WITH v AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (ORDER BY event_id) <= 125) SELECT (place % 5)::INTEGER AS i, (place // 5 % 5)::INTEGER AS j, (place // 25)::INTEGER AS k, round(value, 4) AS value FROM v")
def vector_as_cube(spark, sf_dir):
    from arborkit.operators.matching import numbered

    v = numbered(table(spark, sf_dir, "events").where("value is not null").select("event_id", "value"), [F.col("event_id")]).where("place < 125")
    return im.as_cube(v, "place", 125).select("i", "j", "k", r(F.col("value")).alias("value"))


@register("grid_geometry", f"WITH {BOXES_SQL}, g AS (" + " UNION ALL ".join(f"SELECT neuron_id, '{a}' AS axis, (high_{a} - low_{a}) / (n_{a} - 1) AS voxel, low_{a} AS first, high_{a} AS last FROM box" for a in "xyz") + ") SELECT neuron_id, axis, round(voxel, 6) AS voxel, round(first - voxel / 2, 6) AS low, round(last + voxel / 2, 6) AS high, round(first, 6) AS first, round(last, 6) AS last FROM g")
def grid_geometry(spark, sf_dir):
    """Voxel sizes and outer edges of grids whose first and last centres are given."""
    out = im.geometry_of(boxed(spark, sf_dir), ["neuron_id"])
    return out.select("neuron_id", "axis", *[r(F.col(c), 6).alias(c) for c in ("voxel", "low", "high", "first", "last")])


@register("positions_of_voxels", f"{VOX} SELECT density_id, i, j, k, round({CENTRES[0]!r} + i * {DX!r}, 6) AS x, round({CENTRES[1]!r} + j * {DY!r}, 6) AS y, round({CENTRES[2]!r} + k * {DZ!r}, 6) AS z FROM vox")
def positions_of_voxels(spark, sf_dir):
    at = {c: r(GRID.centre(a, F.col(v)), 6) for a, (c, v) in enumerate(zip("xyz", "ijk"))}
    return voxels(spark, sf_dir).withColumns(at).drop("value")


@register("voxels_of_points", f"WITH {ARBORS_SQL} SELECT neuron_id, point_no, (round_even((x - {CENTRES[0]!r}) / {DX!r}, 0) + 1)::INTEGER AS i, round((y - {CENTRES[1]!r}) / {DY!r} + 1, 7) AS j FROM arbors")
def voxels_of_points(spark, sf_dir):
    return arbors(spark, sf_dir).select("neuron_id", "point_no", im.index_of(GRID, 0, F.col("x")).alias("i"), r(im.index_of(GRID, 1, F.col("y"), False), 7).alias("j"))


# ----------------------------------------------------------------------- resampling
_AT = ", ".join(f"({c} - {o!r}) / {v!r} AS p{c}" for c, o, v in zip("xyz", CENTRES, GRID.voxel))
_LOW = ", ".join(f"least(floor(p{c}), {n - 2})::INTEGER AS l{c}" for c, n in zip("xyz", GRID.n))
_IN = " AND ".join(f"p{c} BETWEEN 0 AND {n - 1}" for c, n in zip("xyz", GRID.n))


def _linear(source):
    """Trilinear values of every volume at ``source(keys.., x, y, z)``."""
    w = " * ".join(f"(CASE WHEN o{c} = 0 THEN 1 - (p{c} - l{c}) ELSE p{c} - l{c} END)" for c in "xyz")
    return f"""frac AS (SELECT *, {_AT} FROM {source}), lo AS (SELECT *, {_LOW}, {_IN} AS inside FROM frac), co AS (SELECT * FROM lo, range(2) a(ox), range(2) b(oy), range(2) c(oz)),
ip AS (SELECT co.*, d.density_id, {w} AS w FROM co, (SELECT DISTINCT density_id FROM vox) d)"""


_MET = "LEFT JOIN vox v ON v.density_id = ip.density_id AND v.i = lx + ox AND v.j = ly + oy AND v.k = lz + oz"


@register("interpolated_linear", f"{VOX}, pts AS (SELECT neuron_id, point_no, x, y, z FROM points), {_linear('pts')} SELECT neuron_id, point_no, ip.density_id, CASE WHEN any_value(inside) THEN round(sum(w * coalesce(v.value, 0)), 9) END AS value FROM ip {_MET} GROUP BY ALL")
def interpolated_linear(spark, sf_dir):
    p = points(spark, sf_dir).select("neuron_id", "point_no", *"xyz")
    return im.interpolated(p, voxels(spark, sf_dir), GRID, ["neuron_id", "point_no"], BY).withColumn("value", r(F.col("value"), 9))


@register("interpolated_constant", f"{VOX}, q AS (SELECT neuron_id, point_no, floor(x / {DX!r})::INTEGER AS i, floor(y / {DY!r})::INTEGER AS j, floor(z / {DZ!r})::INTEGER AS k FROM points) SELECT neuron_id, point_no, d.density_id, CASE WHEN q.i BETWEEN 0 AND 9 AND q.j BETWEEN 0 AND 11 AND q.k BETWEEN 0 AND 7 THEN coalesce(v.value, 0)::DOUBLE END AS value FROM q, (SELECT DISTINCT density_id FROM vox) d LEFT JOIN vox v ON v.density_id = d.density_id AND v.i = q.i AND v.j = q.j AND v.k = q.k")
def interpolated_constant(spark, sf_dir):
    p = points(spark, sf_dir).select("neuron_id", "point_no", *"xyz")
    return im.interpolated(p, voxels(spark, sf_dir), GRID, ["neuron_id", "point_no"], BY, "constant")


TGT = "tgt AS (SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, 1.275 + i * 2.55 AS x, 4.5 + j * 9.0 AS y, 0.7 + k * 1.4 AS z FROM range(20) a(i), range(12) b(j), range(8) c(k))"


@register("resampled_volume", f"{VOX}, {TGT}, {_linear('tgt')} SELECT ip.density_id, ip.i, ip.j, ip.k, CASE WHEN any_value(inside) THEN round(sum(w * coalesce(v.value, 0)), 6) END AS value FROM ip {_MET} GROUP BY ALL")
def resampled_volume(spark, sf_dir):
    return im.resampled(spark, voxels(spark, sf_dir), GRID, TARGET, BY).withColumn("value", r(F.col("value"), 6))


@register("reformatted_volume", f"{VOX}, {TGT.replace('tgt AS', 'raw AS')}, tgt AS (SELECT i, j, k, x + 2.0 AS x, y - 3.0 AS y, z + 0.35 AS z FROM raw), {_linear('tgt')} SELECT ip.density_id, ip.i, ip.j, ip.k, CASE WHEN any_value(inside) THEN round(sum(w * coalesce(v.value, 0)), 6) END AS value FROM ip {_MET} GROUP BY ALL")
def reformatted_volume(spark, sf_dir):
    return im.resampled(spark, voxels(spark, sf_dir), GRID, TARGET, BY, g.translation(2.0, -3.0, 0.35)).withColumn("value", r(F.col("value"), 6))


@register("shrunk_volume", f"{VOX} SELECT density_id, i // 2 AS i, j // 3 AS j, k // 2 AS k, round(sum(value) / 12, 4) AS value FROM vox GROUP BY ALL")
def shrunk_volume(spark, sf_dir):
    return im.shrunk(voxels(spark, sf_dir), (2, 3, 2), BY).withColumn("value", r(F.col("value")))


@register("merged_volumes", f"{VOX} SELECT CASE density_id WHEN 'A' THEN i ELSE i + 10 END::INTEGER AS i, j, k, value FROM vox WHERE density_id IN ('A', 'N')")
def merged_volumes(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return im.merged([v.where(F.col("density_id") == x).drop("density_id") for x in "AN"], "i", [10, 10]).select("i", "j", "k", "value")


@register("stacked_volumes", f"{VOX} SELECT i, j, k, sum(value) FILTER (WHERE density_id = 'A')::DOUBLE AS A, sum(value) FILTER (WHERE density_id = 'N')::DOUBLE AS N, sum(value) FILTER (WHERE density_id = 'R')::DOUBLE AS R FROM vox GROUP BY ALL")
def stacked_volumes(spark, sf_dir):
    wide = voxels(spark, sf_dir).groupBy("i", "j", "k").pivot("density_id", ["A", "N", "R"]).agg(F.sum("value").cast("double"))
    return wide


@register("unstacked_volumes", f"{VOX} SELECT density_id, i, j, k, value FROM vox")
def unstacked_volumes(spark, sf_dir):
    return stacked_volumes(spark, sf_dir).unpivot(["i", "j", "k"], ["A", "N", "R"], "density_id", "value").where("value is not null").select("density_id", "i", "j", "k", F.col("value").cast("long").alias("value"))


@register("normalised_and_smoothed", f"{VOX}, nm AS (SELECT density_id, i, j, k, (greatest(2, least(20, value)) - 2) / 18.0 AS value FROM vox){gauss_sql(3.0, 2.5, 'nm')} SELECT density_id, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, round(value, 6) AS value FROM gz")
def normalised_and_smoothed(spark, sf_dir):
    return im.normalised_and_smoothed(voxels(spark, sf_dir), GRID, 2.0, 20.0, 3.0, BY).withColumn("value", r(F.col("value"), 6))


@register("auto_cropped", f"{VOX}, b AS (SELECT density_id, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(k) AS k0, max(k) AS k1 FROM vox WHERE value >= 4 GROUP BY 1) SELECT density_id, i1 - i0 + 1 AS ni, j1 - j0 + 1 AS nj, k1 - k0 + 1 AS nk, round({CENTRES[0]!r} + i0 * {DX!r}, 5) AS x0, round({CENTRES[1]!r} + j0 * {DY!r}, 5) AS y0, round({CENTRES[2]!r} + k0 * {DZ!r}, 5) AS z0 FROM b")
def auto_cropped(spark, sf_dir):
    return im.auto_cropped(voxels(spark, sf_dir), GRID, 4, BY)[1].select("density_id", "ni", "nj", "nk", *[r(F.col(c), 5).alias(c) for c in ("x0", "y0", "z0")])


@register("simplified_labels", f"{VOX} SELECT density_id, i, j, k, (value % 5 IN (1, 3))::INTEGER AS value FROM vox")
def simplified_labels(spark, sf_dir):
    materials = spark.createDataFrame([(0, "Exterior"), (1, "LH"), (2, "CellBody"), (3, "MB"), (4, "CellBody")], "id long, name string")
    labels = voxels(spark, sf_dir).withColumn("value", F.col("value") % 5)
    return im.labelled(labels, materials, omit=["CellBody", "Exterior"]).select("density_id", "i", "j", "k", "value")


@register("mask_of_values", f"{VOX} SELECT density_id, i, j, k, (value IN (1, 2, 3))::INTEGER AS value FROM vox")
def mask_of_values(spark, sf_dir):
    return d.simplify_labels(voxels(spark, sf_dir), [1, 2, 3])


@register("flipped_masks_united", f"{VOX}, m AS (SELECT density_id, i, j, k, (value > 3)::INTEGER AS value FROM vox), f AS (SELECT density_id, 9 - i AS i, j, k, value FROM m) SELECT density_id, i, j, k, greatest(coalesce(m.value, 0), coalesce(f.value, 0))::DOUBLE AS value FROM m FULL JOIN f USING (density_id, i, j, k)")
def flipped_masks_united(spark, sf_dir):
    masks = voxels(spark, sf_dir).withColumn("value", (F.col("value") > 3).cast("int"))
    return im.flipped_or(masks, "i", 10, BY)


@register("target_grids", f"WITH {BOXES_SQL}, t AS (SELECT neuron_id, " + ", ".join(f"n_{a}, (high_{a} - low_{a}) / (n_{a} - 1) AS d_{a}, CASE WHEN neuron_id % 2 = 0 THEN low_{a} ELSE 0 END AS o_{a}" for a in "xyz") + " FROM box) SELECT neuron_id, " + ", ".join(f"n_{a}, round(o_{a} - d_{a} / 2, 6) AS low_{a}, round(o_{a} - d_{a} / 2 + n_{a} * d_{a}, 6) AS high_{a}" for a in "xyz") + " FROM t")
def target_grids(spark, sf_dir):
    """Targets of nine numbers (origin of the first centre last) and, for odd neurons, of six."""
    rows = boxed(spark, sf_dir)
    voxel = [((F.col(f"high_{a}") - F.col(f"low_{a}")) / (F.col(f"n_{a}") - 1)) for a in "xyz"]
    six = [*[F.col(f"n_{a}").cast("double") for a in "xyz"], *voxel]
    numbers = F.when(F.col("neuron_id") % 2 == 0, F.array(*six, *[F.col(f"low_{a}") for a in "xyz"])).otherwise(F.array(*six))
    out = im.targets(rows.withColumn("target", numbers), "target", ["neuron_id"])
    return out.select("neuron_id", *[c if c.startswith("n_") else r(F.col(c), 6).alias(c) for a in "xyz" for c in (f"n_{a}", f"low_{a}", f"high_{a}")])


# ----------------------------------------------------------------------- statistics
def _more_projections(name, sql):
    @register(f"project_{name}", f"{VOX} SELECT density_id, i, j, round({sql}, 3)::DOUBLE AS value FROM vox GROUP BY ALL")
    def run(spark, sf_dir):
        return d.project(voxels(spark, sf_dir), "k", name, BY).withColumn("value", r(F.col("value").cast("double"), 3))


for _name, _sql in {
    "product": "product(value)", "first": "arg_min(value, k)", "last": "arg_max(value, k)", "slope": "CASE WHEN count(*) > 1 THEN regr_slope(value, k) END", "intercept": "CASE WHEN count(*) > 1 THEN regr_intercept(value, k) END",
    "skew": "CASE WHEN var_pop(value) > 0 THEN (avg(value**3) - 3 * avg(value) * avg(value**2) + 2 * avg(value)**3) / var_pop(value) ** 1.5 END",
}.items():
    _more_projections(_name, _sql)


@register("project_mode", f"{VOX}, c AS (SELECT density_id, i, j, value, count(*) AS n FROM vox GROUP BY ALL) SELECT density_id, i, j, value::DOUBLE AS value FROM c QUALIFY row_number() OVER (PARTITION BY density_id, i, j ORDER BY n DESC, value) = 1")
def project_mode(spark, sf_dir):
    return d.project(voxels(spark, sf_dir), "k", "mode", BY).withColumn("value", F.col("value").cast("double"))


@register("image_statistics", f"{VOX}, mk AS (SELECT i, j, k, value % 2 AS label FROM vox WHERE density_id = 'A'), x AS (SELECT density_id, label, value::DOUBLE AS v FROM vox JOIN mk USING (i, j, k)), h AS (SELECT density_id, label, v, count(*) AS c FROM x GROUP BY ALL), e AS (SELECT density_id, label, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM h GROUP BY ALL)\nSELECT x.density_id, x.label, min(v) AS min, max(v) AS max, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, count(*)::BIGINT AS n, sum(v) AS sum, round(any_value(entropy), 5) AS entropy FROM x JOIN e ON e.density_id = x.density_id AND e.label = x.label GROUP BY ALL")
def image_statistics(spark, sf_dir):
    v = voxels(spark, sf_dir)
    mask = v.where("density_id = 'A'").withColumn("value", F.col("value") % 2)
    return im.statistics(v, mask, BY).withColumns({c: r(F.col(c), 5) for c in ("mean", "sd", "entropy")})


@register("image_range", f"{VOX} SELECT density_id, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max FROM vox GROUP BY 1")
def image_range(spark, sf_dir):
    return im.statistics(voxels(spark, sf_dir), None, BY).select("density_id", "min", "max")


@register("image_similarity", f"{VOX}, p AS (SELECT coalesce(a.value, 0)::DOUBLE AS x, coalesce(b.value, 0)::DOUBLE AS y FROM (SELECT * FROM vox WHERE density_id = 'A') a FULL JOIN (SELECT * FROM vox WHERE density_id = 'N') b USING (i, j, k)) SELECT round(corr(x, y), 5) AS correlation, round(avg((x - y) ** 2), 5) AS msd, round(avg(x * y), 5) AS product, count(*)::BIGINT AS n FROM p")
def image_similarity(spark, sf_dir):
    v = voxels(spark, sf_dir)
    out = im.similarity(v.where("density_id = 'A'"), v.where("density_id = 'N'"), ["i", "j", "k"])
    return out.select(*[r(F.col(c), 5).alias(c) for c in ("correlation", "msd", "product")], "n")


@register("column_deviations", f"{VOX} SELECT i, j, k, round(stddev_samp(value), 5) AS sd FROM vox GROUP BY ALL HAVING count(*) > 1")
def column_deviations(spark, sf_dir):
    return im.deviations(voxels(spark, sf_dir), ["i", "j", "k"]).where("sd is not null").withColumn("sd", r(F.col("sd"), 5))


@register("volume_histogram", f"{VOX} SELECT density_id, least(floor(value / 2.5), 9)::INTEGER AS bin, count(*)::DOUBLE AS count FROM vox WHERE value BETWEEN 0 AND 25 GROUP BY ALL")
def volume_histogram(spark, sf_dir):
    return im.weighted_histogram(voxels(spark, sf_dir), None, 0.0, 25.0, 10, BY)


@register("masked_histogram", f"{VOX}, m AS (SELECT i, j, k, value AS w FROM vox WHERE density_id = 'A') SELECT density_id, least(floor(value / 2.5), 9)::INTEGER AS bin, sum(w)::DOUBLE AS count FROM vox JOIN m USING (i, j, k) WHERE value BETWEEN 0 AND 25 GROUP BY ALL")
def masked_histogram(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return im.weighted_histogram(v, v.where("density_id = 'A'"), 0.0, 25.0, 10, BY)


@register("stack_entropy", f"{VOX}, s AS (SELECT density_id, min(value) AS l, max(value) AS h, count(*) AS n FROM vox GROUP BY 1), b AS (SELECT vox.*, n, coalesce(least(floor((value - l) / nullif(h - l, 0) * 100), 99), 0) AS bin FROM vox JOIN s USING (density_id)), p AS (SELECT density_id, bin, count(*) / any_value(n) AS p FROM b GROUP BY ALL) SELECT i, j, k, round(sum(-p * ln(p)), 5) AS entropy FROM b JOIN p USING (density_id, bin) GROUP BY ALL")
def stack_entropy(spark, sf_dir):
    return im.stack_entropy(voxels(spark, sf_dir), "density_id").withColumn("entropy", r(F.col("entropy"), 5))


@register("information_matrix", f"""{VOX}, e AS (SELECT q.*, t.density_id, coalesce(v.value, 0)::DOUBLE AS value FROM (SELECT DISTINCT i, j, k FROM vox) q, (SELECT DISTINCT density_id FROM vox) t LEFT JOIN vox v ON v.density_id = t.density_id AND v.i = q.i AND v.j = q.j AND v.k = q.k),
pr AS (SELECT a.density_id AS id_a, b.density_id AS id_b, a.value AS a, b.value AS b FROM e a JOIN e b USING (i, j, k) WHERE a.density_id <> b.density_id), sp AS (SELECT id_a, id_b, least(min(a), min(b)) AS low, greatest(max(a), max(b)) AS high FROM pr GROUP BY ALL),
qq AS (SELECT id_a, id_b, ceil((a - low) / ((high - low) / 99)) AS ba, ceil((b - low) / ((high - low) / 99)) AS bb FROM pr JOIN sp USING (id_a, id_b) WHERE a > low AND b > low),
c1 AS (SELECT id_a, id_b, ba, count(*)::DOUBLE AS c FROM qq GROUP BY ALL), c2 AS (SELECT id_a, id_b, bb, count(*)::DOUBLE AS c FROM qq GROUP BY ALL), c3 AS (SELECT id_a, id_b, ba, bb, count(*)::DOUBLE AS c FROM qq GROUP BY ALL),
h1 AS (SELECT id_a, id_b, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM c1 GROUP BY ALL), h2 AS (SELECT id_a, id_b, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM c2 GROUP BY ALL), h3 AS (SELECT id_a, id_b, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM c3 GROUP BY ALL)
SELECT h1.id_a, h1.id_b, round(2 / ((h1.h + h2.h) / h3.h) - 1, 4) AS mi_distance FROM h1 JOIN h2 USING (id_a, id_b) JOIN h3 USING (id_a, id_b)""")
def information_matrix(spark, sf_dir):
    return im.information_matrix(voxels(spark, sf_dir), "density_id", stats.entropies).withColumn("mi_distance", r(F.col("mi_distance")))


KDE_GRID = d.Grid((6, 6, 4), GRID.low, GRID.high)


@register("density_estimate", f"""WITH {ARBORS_SQL}, g AS (SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, (i + 0.5) * 8.5 AS gx, (j + 0.5) * 18.0 AS gy, (k + 0.5) * 2.8 AS gz FROM range(6) a(i), range(6) b(j), range(4) c(k)),
v AS (SELECT region, i, j, k, sum(exp(-((x-gx)**2) / 32 - ((y-gy)**2) / 128 - ((z-gz)**2) / 4.5)) AS value FROM arbors, g GROUP BY ALL) SELECT region, i, j, k, round(value / sum(value) OVER (PARTITION BY region), 8) AS value FROM v""")
def density_estimate(spark, sf_dir):
    out = im.density_estimate(spark, arbors(spark, sf_dir), KDE_GRID, (4.0, 8.0, 1.5), ["region"])
    return out.withColumn("value", r(F.col("value"), 8))


# ------------------------------------------------------------ t maps and permutations
@register("permuted_t_maps", """WITH e AS (SELECT hour(ts)::INTEGER AS voxel, user_id, value FROM events WHERE value IS NOT NULL), u AS (SELECT DISTINCT user_id FROM e), n1 AS (SELECT count(*) // 2 AS n FROM u),
l AS (SELECT user_id, perm::INTEGER AS perm, row_number() OVER (PARTITION BY perm ORDER BY md5(concat(user_id, ':', perm, ':11')), user_id) <= (SELECT n FROM n1) AS one FROM u, range(1, 6) p(perm)),
g AS (SELECT perm, voxel, count(*) FILTER (WHERE one) AS n1, count(*) FILTER (WHERE NOT one) AS n2, avg(value) FILTER (WHERE one) AS m1, avg(value) FILTER (WHERE NOT one) AS m2, var_samp(value) FILTER (WHERE one) AS v1, var_samp(value) FILTER (WHERE NOT one) AS v2 FROM e JOIN l USING (user_id) GROUP BY ALL)
SELECT perm, voxel, n1::BIGINT AS n1, n2::BIGINT AS n2, round((m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2)/(n1+n2-2) * (1.0/n1 + 1.0/n2)), 4) AS t FROM g WHERE n1 > 1 AND n2 > 1""")
def permuted_t_maps(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select(F.hour("ts").alias("voxel"), "user_id", "value")
    return stats.permuted_t(e, ["voxel"], "user_id", "value", 5, 11).withColumn("t", r(F.col("t")))


@register("paired_deviations_t", """WITH e AS (SELECT hour(ts)::INTEGER AS voxel, user_id % 2 = 1 AS one, value FROM events WHERE value IS NOT NULL),
g AS (SELECT voxel, count(*) FILTER (WHERE one) AS n1, count(*) FILTER (WHERE NOT one) AS n2, avg(value) FILTER (WHERE one) AS m1, avg(value) FILTER (WHERE NOT one) AS m2, var_pop(value) FILTER (WHERE one) AS v1, var_pop(value) FILTER (WHERE NOT one) AS v2 FROM e GROUP BY voxel)
SELECT voxel, round((m1 - m2) / sqrt((n1*v1 + n2*v2)/(n1+n2-2) * (1.0/n1 + 1.0/n2)), 4) AS t FROM g WHERE n1 > 1 AND n2 > 1""")
def paired_deviations_t(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select(F.hour("ts").alias("voxel"), (F.col("user_id") % 2 == 1).alias("one"), "value")
    return stats.pooled_t(e, ["voxel"], "one", "value").select("voxel", r(F.col("t")).alias("t"))


# ---------------------------------------------------------------- cumulative normal
def _balances(spark, sf_dir, width=1.0):
    """Histograms of normal distributions with each nation's mean and deviation of balances."""
    from arborkit.functions.scalars import cumnorm

    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("mu"), (width * F.stddev_pop("c_acctbal")).alias("sigma")).where("sigma > 0")
    rows = c.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(119))))
    edge = lambda n: F.col("mu") + (n - 60) / 10 * F.col("sigma")
    share = cumnorm(edge(F.col("bin") + 1), F.col("mu"), F.col("sigma")) - cumnorm(edge(F.col("bin")), F.col("mu"), F.col("sigma"))
    return rows.select("id", "bin", edge(F.col("bin") + 1).alias("hi"), (1e9 * share).alias("count"))


BALANCES_SQL = "WITH c AS (SELECT c_nationkey AS id, avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sigma FROM customer GROUP BY 1)"


@register("normal_fits", f"{BALANCES_SQL} SELECT id, round(mu / sigma, 4) AS mu_by_sigma, round(sigma, 2) AS sigma, round(mu + 2 * sigma, 1) AS threshold FROM c WHERE sigma > 0")
def normal_fits(spark, sf_dir):
    """The fit must find the distributions that the histograms were made of."""
    out = im.background(_balances(spark, sf_dir), "id")
    return out.select("id", r(F.col("mu") / F.col("sigma")).alias("mu_by_sigma"), r(F.col("sigma"), 2).alias("sigma"), r(F.col("threshold"), 1).alias("threshold"))


@register("background_fits")
def background_fits(spark, sf_dir):
    hist = stats.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 100.0, 50).withColumn("hi", (F.col("bin") + 1) * 2.0)
    return im.background(hist, "event_type", 0.9).select("event_type", *[r(F.col(c), 3).alias(c) for c in ("mu", "sigma", "threshold")])


@register("cumulative_corners")
def cumulative_corners(spark, sf_dir):
    hist = stats.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 100.0, 50).withColumn("hi", (F.col("bin") + 1) * 2.0)
    return im.cumulative_corner(hist, "event_type")


@register("background_refreshed", f"{BALANCES_SQL} SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 3 THEN 2 ELSE 1 END AS version, round(mu / sigma, 4) AS mu_by_sigma, round(sigma, 2) AS sigma FROM c WHERE sigma > 0 AND id % 11 <> 10")
def background_refreshed(spark, sf_dir):
    """Fits kept between two runs: before the second, some histograms change, some are added and some removed."""
    from arborkit.operators import refresh
    from arborkit.sources.files import scratch

    path = scratch(spark, "backgrounds")
    now, wide = _balances(spark, sf_dir), _balances(spark, sf_dir, 2.0)
    before = now.where("id % 5 <> 0").unionByName(wide.where("id % 5 = 0")).where("id % 7 <> 3")
    first = refresh.refreshed_backgrounds(spark, path, before, "id").select("id", "digest", F.lit(True).alias("old"))
    second = refresh.refreshed_backgrounds(spark, path, now.where("id % 11 <> 10"), "id")
    out = second.join(first, ["id", "digest"], "left")
    return out.select("id", F.when(F.col("old"), 1).otherwise(2).alias("version"), r(F.col("mu") / F.col("sigma")).alias("mu_by_sigma"), r(F.col("sigma"), 2).alias("sigma"))


@register("neuron_table", f"""WITH {ARBORS_SQL}, a AS (SELECT neuron_id, count(*) AS n_points, count(*) FILTER (WHERE parent = -1) AS n_trees FROM arbors GROUP BY 1)
SELECT s_suppkey AS neuron_id, s_nationkey AS brain, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INTEGER AS sequence, coalesce(n_points, 0)::BIGINT AS n_points, n_trees FROM supplier LEFT JOIN a ON neuron_id = s_suppkey""")
def neuron_table(spark, sf_dir):
    from arborkit.operators import tree

    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("neuron_id"), F.col("s_nationkey").alias("brain"))
    counts = tree.tree_counts(arbors(spark, sf_dir)).select("neuron_id", "n_points", F.col("n_trees"))
    rows = n.withColumn("sequence", F.row_number().over(Window.partitionBy("brain").orderBy("neuron_id"))).join(counts, "neuron_id", "left")
    return rows.withColumn("n_points", F.coalesce("n_points", F.lit(0)))


# ------------------------------------------------------------------------------ hulls
def hull_sql(name: str, source: str, keys: str = "neuron_id") -> str:
    """Facets of each set of points in general position: the triples that have all other points on one side.

    ``{name}`` holds a facet's corners, outward normal (not unit) and first corner.
    """
    n = {"nx": "(b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y)", "ny": "(b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z)", "nz": "(b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x)"}
    return f"""{name}_t AS (SELECT a.{keys}, a.dot_id AS p, b.dot_id AS q, c.dot_id AS r, a.x, a.y, a.z, {', '.join(f'{v} AS {k}' for k, v in n.items())}
  FROM {source} a JOIN {source} b ON a.{keys} = b.{keys} AND a.dot_id < b.dot_id JOIN {source} c ON a.{keys} = c.{keys} AND b.dot_id < c.dot_id),
{name}_s AS (SELECT t.*, bool_and(nx*(o.x-t.x) + ny*(o.y-t.y) + nz*(o.z-t.z) < 0) AS out, bool_and(nx*(o.x-t.x) + ny*(o.y-t.y) + nz*(o.z-t.z) > 0) AS inw
  FROM {name}_t t JOIN {source} o ON o.{keys} = t.{keys} AND o.dot_id NOT IN (p, q, r) GROUP BY ALL),
{name} AS (SELECT {keys}, p, q, r, x, y, z, CASE WHEN out THEN nx ELSE -nx END AS nx, CASE WHEN out THEN ny ELSE -ny END AS ny, CASE WHEN out THEN nz ELSE -nz END AS nz FROM {name}_s WHERE out OR inw)"""


#: 21 points of each vector, and parts of them.
DOTTED = """cl AS (SELECT vec_id AS neuron_id, dot_id::INTEGER AS dot_id, embedding[dot_id*3+1]::DOUBLE AS x, embedding[dot_id*3+2]::DOUBLE AS y, embedding[dot_id*3+3]::DOUBLE AS z
FROM (SELECT vec_id, embedding, unnest(range(0, 21)) AS dot_id FROM embeddings))"""


def _volumes(name, source):
    """Volumes by the tetrahedra that facets make with the mean of the points."""
    return f"""{hull_sql(name, source)}, {name}_v AS (SELECT neuron_id, sum((nx*(f.x-m.x) + ny*(f.y-m.y) + nz*(f.z-m.z)) / 6) AS volume, sum(sqrt(nx**2+ny**2+nz**2) / 2) AS area, count(*) / 2 + 2 AS corners
  FROM {name} f JOIN (SELECT neuron_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {source} GROUP BY 1) m USING (neuron_id) GROUP BY 1)"""


@register("hull_volumes", f"WITH {DOTTED}, {_volumes('f', 'cl')} SELECT neuron_id, round(volume, 7) AS volume, round(area, 6) AS area, corners::INTEGER AS corners FROM f_v")
def hull_volumes(spark, sf_dir):
    return im.hull_measures(clouds(spark, sf_dir), "neuron_id").select("neuron_id", r(F.col("volume"), 7).alias("volume"), r(F.col("area"), 6).alias("area"), "corners")


@register("hull_planes", f"WITH {DOTTED}, {hull_sql('f', 'cl')}, u AS (SELECT *, sqrt(nx**2+ny**2+nz**2) AS l FROM f) SELECT neuron_id, round(nx/l, 5) + 0.0 AS a, round(ny/l, 5) + 0.0 AS b, round(nz/l, 5) + 0.0 AS c, round(-(nx*x + ny*y + nz*z) / l, 5) + 0.0 AS d FROM u")
def hull_planes(spark, sf_dir):
    out = im.hull_planes(clouds(spark, sf_dir), "neuron_id")
    return out.select("neuron_id", *[(r(F.col(c), 5) + 0.0).alias(c) for c in "abcd"])


@register("inside_hull", f"""WITH {DOTTED}, part AS (SELECT * FROM cl WHERE dot_id < 13), {hull_sql('f', 'part')}
SELECT cl.neuron_id, cl.dot_id, bool_and((nx*(cl.x-f.x) + ny*(cl.y-f.y) + nz*(cl.z-f.z)) / sqrt(nx**2+ny**2+nz**2) <= 1e-6) AS inside FROM cl JOIN f USING (neuron_id) GROUP BY ALL""")
def inside_hull(spark, sf_dir):
    """All dots of a cloud against the hull of its first thirteen."""
    dots = clouds(spark, sf_dir)
    return im.inside_hull(dots, im.hull_planes(dots.where("dot_id < 13"), "neuron_id"), "neuron_id", ["dot_id"])


@register("hull_overlaps", f"""WITH {DOTTED}, one AS (SELECT * FROM cl WHERE dot_id <= 10), two AS (SELECT * FROM cl WHERE dot_id >= 10), {_volumes('f1', 'one')}, {_volumes('f2', 'two')}, {_volumes('f12', 'cl')}
SELECT a.neuron_id, round(a.volume + b.volume - u.volume, 6) AS overlap, round((a.volume + b.volume - u.volume) / a.volume, 4) AS of_first, round((a.volume + b.volume - u.volume) / (a.volume + b.volume), 4) AS of_both
FROM f1_v a JOIN f2_v b USING (neuron_id) JOIN f12_v u USING (neuron_id)""")
def hull_overlaps(spark, sf_dir):
    """The first and the last dots of each cloud: volumes of both hulls less that of the hull around both."""
    dots = clouds(spark, sf_dir)
    out = im.hull_overlap(dots.where("dot_id <= 10"), dots.where("dot_id >= 10"), "neuron_id")
    return out.select("neuron_id", r(F.col("overlap"), 6).alias("overlap"), *[r(F.col(c)).alias(c) for c in ("of_first", "of_both")])


@register("outlines", f"""WITH {DOTTED}, side AS (SELECT a.neuron_id, a.dot_id, a.x, a.y, b.dot_id AS other, b.x - a.x AS ux, b.y - a.y AS uy, bool_and((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) > 0) AS edge
  FROM cl a JOIN cl b ON a.neuron_id = b.neuron_id AND a.dot_id <> b.dot_id JOIN cl c ON c.neuron_id = a.neuron_id AND c.dot_id NOT IN (a.dot_id, b.dot_id) GROUP BY ALL)
SELECT neuron_id, row_number() OVER (PARTITION BY neuron_id ORDER BY dot_id)::INTEGER AS place, dot_id, round(x, 6) AS x, round(y, 6) AS y FROM side WHERE edge""")
def outlines(spark, sf_dir):
    """Clouds as contours, thinned to the corners of their hull in x and y, in their own order."""
    out = im.outlines(clouds(spark, sf_dir), ["neuron_id"], "dot_id")
    return out.select("neuron_id", "place", "dot_id", r(F.col("x"), 6).alias("x"), r(F.col("y"), 6).alias("y"))


# ------------------------------------------------------------------------------ planes
@register("plane_from_three_points", f"WITH {ARBORS_SQL} SELECT neuron_id, point_no, round(-2 * x + 5 * y + 3 * z - 10, 6) AS side FROM arbors")
def plane_from_three_points(spark, sf_dir):
    plane = g.plane_from_points([0, 2, 0], [5, 4, 0], [0, -1, 5])
    return arbors(spark, sf_dir).select("neuron_id", "point_no", r(g.side_of_plane(plane) / (plane[0] / -2), 6).alias("side"))


@register("plane_from_point_and_normal", f"WITH {ARBORS_SQL} SELECT neuron_id, point_no, round(2 * x - y + 0.5 * z - 1, 6) AS side FROM arbors")
def plane_from_point_and_normal(spark, sf_dir):
    plane = g.plane_from_point_and_normal([1, 2, 2], [2, -1, 0.5])
    return arbors(spark, sf_dir).select("neuron_id", "point_no", r(g.side_of_plane(plane), 6).alias("side"))


@register("places_on_plane", f"WITH {ARBORS_SQL} SELECT neuron_id, point_no, round(x - 1, 6) AS u, round(-(y - 2), 6) AS v FROM arbors")
def places_on_plane(spark, sf_dir):
    return g.place_on_plane(arbors(spark, sf_dir), (0.0, 0.0, 2.0, -3.0), (1.0, 2.0, 3.0)).select("neuron_id", "point_no", r(F.col("u"), 6).alias("u"), r(F.col("v"), 6).alias("v"))


# ------------------------------------------------------------------------------- warps
SPACING = (8.0, 16.0, 4.0)
#: A grid of 10 x 10 x 6 control points, each moved by what the first line of its keys says: a curved, invertible warp.
CONTROLS_SQL = """first AS (SELECT l_orderkey % 10 AS i, l_partkey % 10 AS j, l_suppkey % 6 AS k, min((l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_quantity)) AS f FROM lineitem GROUP BY ALL),
ctl AS MATERIALIZED (SELECT i, j, k, (i - 1) * 8.0 + 20 * (f[5] - 0.05) AS cx, (j - 1) * 16.0 + 25 * (f[6] - 0.04) AS cy, (k - 1) * 4.0 + (f[7] - 25.5) / 50 AS cz FROM first)"""


def _spline_sql(source: str, keys: str, controls: str = "ctl") -> str:
    """``met``: each point with its 64 control points, their weights w and the weights' slopes d by axis."""
    weight = "[(1-{u})**3/6, (3*{u}**3-6*{u}**2+4)/6, (-3*{u}**3+3*{u}**2+3*{u}+1)/6, {u}**3/6]"
    slope = "[-((1-{u})**2)/2, (3*{u}**2-4*{u})/2, (-3*{u}**2+2*{u}+1)/2, {u}**2/2]"
    lists = ", ".join(f"{form.format(u='u' + a)} AS {t}{a}" for a in "xyz" for t, form in (("w", weight), ("d", slope)))
    picked = ", ".join(f"{t}{a}[c.{n} - g{a} + 1] AS {t}{a}" for a, n in zip("xyz", "ijk") for t in "wd")
    return f"""frac AS (SELECT {keys}, x, y, z, {', '.join(f'floor({a}/{d})::BIGINT AS g{a}, {a}/{d} - floor({a}/{d}) AS u{a}' for a, d in zip('xyz', SPACING))} FROM {source}),
lists AS (SELECT *, {lists} FROM frac),
met AS (SELECT {keys}, l.x, l.y, l.z, {picked}, c.cx AS px, c.cy AS py, c.cz AS pz FROM lists l CROSS JOIN (SELECT a, b, c FROM range(4) t(a), range(4) s(b), range(4) q(c)) o JOIN {controls} c ON c.i = l.gx + o.a AND c.j = l.gy + o.b AND c.k = l.gz + o.c)"""


_IMAGE = ", ".join(f"sum(wx*wy*wz*p{a}) AS t{a}" for a in "xyz") + ", count(*) AS n"
_PLACED = "placed AS (SELECT neuron_id, point_no, x, y, z FROM arbors)"


def _controls(spark, sf_dir):
    keys = {"i": F.col("l_orderkey") % 10, "j": F.col("l_partkey") % 10, "k": F.col("l_suppkey") % 6}
    lines = table(spark, sf_dir, "lineitem").withColumns(keys)
    # the least order of each first (a struct's least is found by sorting all rows)
    first = F.broadcast(lines.groupBy(*keys).agg(F.min("l_orderkey").alias("l_orderkey")))
    rows = lines.join(first, [*keys, "l_orderkey"]).groupBy(*keys).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity")).alias("f"))
    moves = {"cx": (F.col("i") - 1) * 8.0 + 20 * (F.col("f.l_discount") - 0.05), "cy": (F.col("j") - 1) * 16.0 + 25 * (F.col("f.l_tax") - 0.04), "cz": (F.col("k") - 1) * 4.0 + (F.col("f.l_quantity") - 25.5) / 50}
    return rows.select("i", "j", "k", *[v.alias(n) for n, v in moves.items()])


def _placed(spark, sf_dir):
    return arbors(spark, sf_dir).select("neuron_id", "point_no", *"xyz")


@register("warped_points", f"WITH {ARBORS_SQL}, {CONTROLS_SQL}, {_PLACED}, {_spline_sql('placed', 'neuron_id, point_no')}, t AS (SELECT neuron_id, point_no, {_IMAGE} FROM met GROUP BY 1, 2) SELECT neuron_id, point_no, {', '.join(f'CASE WHEN n = 64 THEN round(t{a}, 5) END AS {a}' for a in 'xyz')} FROM placed LEFT JOIN t USING (neuron_id, point_no)")
def warped_points(spark, sf_dir):
    out = reg.warp_points(_placed(spark, sf_dir), _controls(spark, sf_dir), SPACING)
    return out.select("neuron_id", "point_no", *[r(F.col(a), 5).alias(a) for a in "xyz"])


@register("warped_with_fallback", f"WITH {ARBORS_SQL}, {CONTROLS_SQL}, few AS (SELECT * FROM ctl WHERE i < 7), {_PLACED}, {_spline_sql('placed', 'neuron_id, point_no', 'few')}, t AS (SELECT neuron_id, point_no, {_IMAGE} FROM met GROUP BY 1, 2) SELECT neuron_id, point_no, round(CASE WHEN n = 64 THEN tx ELSE x + 100 END, 5) AS x FROM placed LEFT JOIN t USING (neuron_id, point_no)")
def warped_with_fallback(spark, sf_dir):
    """Without the control points beyond the seventh, points there take an affine map."""
    out = reg.warp_points(_placed(spark, sf_dir), _controls(spark, sf_dir).where("i < 7"), SPACING)
    return reg.with_fallback(out, g.translation(100, 0, 0)).select("neuron_id", "point_no", r(F.col("x"), 5).alias("x"))


_SLOPES = ", ".join(f"sum({'*'.join(('d' if n == b else 'w') + n for n in 'xyz')}*p{a}) / {d} AS j{a}{b}" for a in "xyz" for b, d in zip("xyz", SPACING))
_JACOBIAN = f"WITH {ARBORS_SQL}, {CONTROLS_SQL}, {_PLACED}, {_spline_sql('placed', 'neuron_id, point_no')}, t AS (SELECT neuron_id, point_no, {_SLOPES}, count(*) AS n FROM met GROUP BY 1, 2 HAVING count(*) = 64)"


@register("warp_jacobians", f"{_JACOBIAN} SELECT neuron_id, point_no, {', '.join(f'round(j{a}{b}, 6) AS j{a}{b}' for a in 'xyz' for b in 'xyz')} FROM placed LEFT JOIN t USING (neuron_id, point_no)")
def warp_jacobians(spark, sf_dir):
    out = reg.warp_jacobians(_placed(spark, sf_dir), _controls(spark, sf_dir), SPACING)
    return out.select("neuron_id", "point_no", *[r(F.col(f"j{a}{b}"), 6).alias(f"j{a}{b}") for a in "xyz" for b in "xyz"])


@register("volume_changes", f"{_JACOBIAN} SELECT neuron_id, point_no, round(jxx*(jyy*jzz - jyz*jzy) - jxy*(jyx*jzz - jyz*jzx) + jxz*(jyx*jzy - jyy*jzx), 5) AS change FROM placed LEFT JOIN t USING (neuron_id, point_no)")
def volume_changes(spark, sf_dir):
    """The warp's local scale: the determinant of its derivatives."""
    return reg.warp_jacobians(_placed(spark, sf_dir), _controls(spark, sf_dir), SPACING).select("neuron_id", "point_no", r(F.col("change"), 5).alias("change"))


@register("volume_changes_by_tetrahedra", f"""WITH {ARBORS_SQL}, {CONTROLS_SQL}, corner AS (SELECT neuron_id, point_no, corner, x + h*sx AS x, y + h*sy AS y, z + h*sz AS z FROM arbors, (SELECT 0.5 / sqrt(8.0) AS h) s, (VALUES (0, 1, 1, 1), (1, 1, -1, -1), (2, -1, 1, -1), (3, -1, -1, 1)) c(corner, sx, sy, sz)),
{_spline_sql('corner', 'neuron_id, point_no, corner')}, t AS (SELECT neuron_id, point_no, corner, {_IMAGE} FROM met GROUP BY 1, 2, 3),
e AS (SELECT neuron_id, point_no, min(n) AS n, count(*) AS corners, {', '.join(f'max(t{a}) FILTER (WHERE corner = {c}) - max(t{a}) FILTER (WHERE corner = 0) AS {a}{c}' for a in 'xyz' for c in (1, 2, 3))} FROM t GROUP BY 1, 2)
SELECT a.neuron_id, a.point_no, CASE WHEN n = 64 AND corners = 4 THEN round(abs(x1*(y2*z3 - z2*y3) + y1*(z2*x3 - x2*z3) + z1*(x2*y3 - y2*x3)) / 6 / (0.125 / (6 * sqrt(2.0))), 5) END AS change FROM arbors a LEFT JOIN e USING (neuron_id, point_no)""")
def volume_changes_by_tetrahedra(spark, sf_dir):
    """Volumes of small tetrahedra after the warp over their volumes before."""
    corners = reg.tetrahedra(_placed(spark, sf_dir), 0.5)
    keys = ["neuron_id", "point_no"]
    moved = reg.warp_points(corners, _controls(spark, sf_dir), SPACING)
    return reg.corner_volume(moved, keys, before=True).select(*keys, r(F.col("volume") / F.col("before"), 5).alias("change"))


@register("warp_undone", f"WITH {ARBORS_SQL}, {CONTROLS_SQL}, {_PLACED}, {_spline_sql('placed', 'neuron_id, point_no')}, t AS (SELECT neuron_id, point_no, count(*) AS n FROM met GROUP BY 1, 2) SELECT neuron_id, point_no, {', '.join(f'CASE WHEN n = 64 THEN round({a}, 6) END AS {a}' for a in 'xyz')} FROM placed LEFT JOIN t USING (neuron_id, point_no)")
def warp_undone(spark, sf_dir):
    """The inverse of the curved warp takes images back to where they came from."""
    controls = _controls(spark, sf_dir)
    moved = reg.warp_points(_placed(spark, sf_dir), controls, SPACING).select("neuron_id", "point_no", *"xyz")
    return reg.unwarp_points(moved, controls, SPACING).select("neuron_id", "point_no", *[r(F.col(a), 6).alias(a) for a in "xyz"])


@register("deformation_field", f"""WITH {ARBORS_SQL}, {CONTROLS_SQL}, box AS (SELECT region, {', '.join(f'min({a}) AS {a}0, max({a}) AS {a}1' for a in 'xyz')} FROM arbors GROUP BY 1),
placed AS (SELECT region, i::INTEGER AS gi, j::INTEGER AS gj, k::INTEGER AS gk, x0 + i * (x1 - x0) / 9 AS x, y0 + j * (y1 - y0) / 9 AS y, z0 + k * (z1 - z0) / 4 AS z FROM box, range(10) a(i), range(10) b(j), range(5) c(k)),
{_spline_sql('placed', 'region, gi, gj, gk')}, t AS (SELECT region, gi, gj, gk, {_IMAGE} FROM met GROUP BY 1, 2, 3, 4)
SELECT region, gi, gj, gk, {', '.join(f'CASE WHEN n = 64 THEN round(t{a} - {a}, 5) END AS d{a}' for a in 'xyz')} FROM placed LEFT JOIN t USING (region, gi, gj, gk)""")
def deformation_field(spark, sf_dir):
    """What the warp adds to the places of a grid over each region's box."""
    box = arbors(spark, sf_dir).groupBy("region").agg(*[f(a).alias(f"{a}{n}") for a in "xyz" for n, f in ((0, F.min), (1, F.max))])
    for c, n in (("gi", 9), ("gj", 9), ("gk", 4)):
        box = box.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n))))
    places = box.select("region", "gi", "gj", "gk", *[(F.col(f"{a}0") + F.col(c) * (F.col(f"{a}1") - F.col(f"{a}0")) / n).alias(a) for a, c, n in (("x", "gi", 9), ("y", "gj", 9), ("z", "gk", 4))])
    out = reg.warp_points(places, _controls(spark, sf_dir), SPACING)
    return out.select("region", "gi", "gj", "gk", *[r(F.col(a) - F.col(f"from_{a}"), 5).alias(f"d{a}") for a in "xyz"])


#: A matrix for each neuron, from its supplier's row.
_ENTRIES = ["1.2 + {n} / 100", "0.1 - {b}", "0.05", "3.0 + {n}", "{b}", "0.9", "0.2 - {n} / 200", "-2.0", "0.01 * {n}", "0.1", "1.1 + {b}", "5 * {b}"]
_NUMBERS = {"n": "s_nationkey::DOUBLE", "b": "s_acctbal / 50000"}
_M = [e.format(**_NUMBERS) for e in _ENTRIES]


def _cramer():
    m = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    det = lambda a: f"({a[0][0]}*({a[1][1]}*{a[2][2]} - {a[1][2]}*{a[2][1]}) - {a[0][1]}*({a[1][0]}*{a[2][2]} - {a[1][2]}*{a[2][0]}) + {a[0][2]}*({a[1][0]}*{a[2][1]} - {a[1][1]}*{a[2][0]}))"
    right = [f"({a} - m{i}3)" for i, a in enumerate("xyz")]
    return ", ".join(f"round({det([[right[i] if j == c else m[i][j] for j in range(3)] for i in range(3)])} / {det(m)}, 5) AS {a}" for c, a in enumerate("xyz"))


@register("affine_undone", f"WITH {ARBORS_SQL}, m AS (SELECT s_suppkey, {', '.join(f'{v} AS m{i // 4}{i % 4}' for i, v in enumerate(_M))} FROM supplier) SELECT neuron_id, point_no, {_cramer()} FROM arbors LEFT JOIN m ON s_suppkey = neuron_id")
def affine_undone(spark, sf_dir):
    """Points through the inverse of their own neuron's matrix."""
    entries = [e.format(n="cast(s_nationkey as double)", b="s_acctbal / 50000") for e in _ENTRIES]
    matrices = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("neuron_id"), F.array(*[F.expr(f"cast({e} as double)") for e in entries]).alias("matrix"))
    back = reg.invert_by(_placed(spark, sf_dir), matrices, "neuron_id")
    return back.select("neuron_id", "point_no", *[r(F.col(a), 5).alias(a) for a in "xyz"])


# --------------------------------------------------------------------------------- ICA
@register("component_mask", f"{VOX}, s AS (SELECT i, j, k, sum(value) AS t FROM vox GROUP BY ALL) SELECT i, j, k, (t >= 0.1 * (SELECT max(t) FROM s))::INTEGER AS value FROM s")
def component_mask(spark, sf_dir):
    return im.component_mask(voxels(spark, sf_dir))


@register("independent_components")
def independent_components(spark, sf_dir):
    return im.independent_components(voxels(spark, sf_dir), "density_id", 2)[1].withColumn("value", r(F.col("value")))


@register("density_estimate_2d", f"""WITH {ARBORS_SQL}, g AS (SELECT i::INTEGER AS i, j::INTEGER AS j, (i + 0.5) * 5.1 AS gx, (j + 0.5) * 9.0 AS gy FROM range(10) a(i), range(12) b(j)),
v AS (SELECT region, i, j, sum(exp(-((x-gx)**2) / 32 - ((y-gy)**2) / 128)) AS value FROM arbors, g GROUP BY ALL) SELECT region, i, j, round(value / sum(value) OVER (PARTITION BY region), 8) AS value FROM v""")
def density_estimate_2d(spark, sf_dir):
    flat = arbors(spark, sf_dir).withColumn("z", F.lit(0.0))
    out = im.density_estimate(spark, flat, d.Grid((10, 12, 1), (0.0, 0.0, -1.0), (51.0, 108.0, 1.0)), (4.0, 8.0, 1.0), ["region"])
    return out.select("region", "i", "j", r(F.col("value"), 8).alias("value"))


@register("registrations_of_brains", "WITH k AS (SELECT DISTINCT o_custkey AS brain FROM orders), n AS (SELECT c_custkey, c_name FROM customer) SELECT brain, '/reg/' || c_name || '.list' AS path FROM k LEFT JOIN n ON c_custkey = brain AND brain % 3 > 0")
def registrations_of_brains(spark, sf_dir):
    """Registration paths by brain from a table of traces; unknown brains stay, without a path."""
    brains = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("brain")).distinct()
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("brain"), F.concat(F.lit("/reg/"), "c_name", F.lit(".list")).alias("path"))
    return rg.names_of(known, brains, "brain")
