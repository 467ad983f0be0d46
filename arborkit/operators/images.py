"""Grids, resampling, masks, statistics and fits of voxel tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborkit.sources.files import scratch

from .density import VOXEL, Grid, combine, crop, flip, gaussian_smooth

AXES = "xyz"


# ---------------------------------------------------------------------------- grids
def grid_of(target: Grid | list[float] | tuple[float, ...]) -> Grid:
    """A grid from one, from six numbers (sizes, voxel sizes; origin 0) or nine (origin of the first centre last)."""
    if isinstance(target, Grid):
        return target
    n, d, origin = target[:3], target[3:6], target[6:9] or (0.0, 0.0, 0.0)
    if len(target) not in (6, 9):
        raise ValueError("a target has six or nine numbers")
    low = tuple(o - v / 2 for o, v in zip(origin, d))
    return Grid(tuple(map(int, n)), low, tuple(l + v * int(c) for l, v, c in zip(low, d, n)))


def bounds_from_box(box: list[tuple[float, float]], n: tuple[int, int, int]) -> list[tuple[float, float]]:
    """Outer edges from the centres of the first and last voxel."""
    return [(a - (b - a) / (c - 1) / 2, b + (b - a) / (c - 1) / 2) for (a, b), c in zip(box, n)]


def voxel_size(box: list[tuple[float, float]], n: tuple[int, int, int]) -> list[float]:
    return [(b - a) / (c - 1) for (a, b), c in zip(box, n)]


def expanded(spark, grid: Grid) -> DataFrame:
    """Every voxel with its centre, generated where it is used."""
    total = grid.n[0] * grid.n[1] * grid.n[2]
    at = F.col("id")
    rows = spark.range(total).select((at % grid.n[0]).cast("int").alias("i"), (F.floor(at / grid.n[0]) % grid.n[1]).cast("int").alias("j"), F.floor(at / (grid.n[0] * grid.n[1])).cast("int").alias("k"))
    return rows.withColumns({c: grid.centre(a, F.col(v)) for a, (c, v) in enumerate(zip(AXES, VOXEL))})


def regular_grid(spark, low: tuple[float, float, float], high: tuple[float, float, float], spacing: float, margins: bool = False) -> DataFrame:
    """Points every ``spacing`` within bounds: centres of cells, or their margins."""
    shift = 0.0 if margins else spacing / 2
    n = [int(math.floor((h - l - shift) / spacing + 1e-9)) + 1 for l, h in zip(low, high)]
    at = F.col("id")
    index = (at % n[0], F.floor(at / n[0]) % n[1], F.floor(at / (n[0] * n[1])))
    return spark.range(n[0] * n[1] * n[2]).select(*[(l + shift + i * spacing).alias(c) for c, l, i in zip(AXES, low, index)])


def mesh(spark, n: tuple[int, int, int], size: tuple[float, float, float]) -> DataFrame:
    """``n`` points an axis from 0 to ``size``."""
    step = [s / max(1, c - 1) for s, c in zip(size, n)]
    at = F.col("id")
    index = (at % n[0], F.floor(at / n[0]) % n[1], F.floor(at / (n[0] * n[1])))
    return spark.range(n[0] * n[1] * n[2]).select(*[(i * d).alias(c) for c, i, d in zip(AXES, index, step)])


# Tables of grids: ``n_x, low_x, high_x`` and so on, a row each.
def _spread(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """A row for every combination of indices 0.. below the counts."""
    for name, n in counts.items():
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return rows


def boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """``low_x, high_x`` .. of each group's points."""
    return points.groupBy(*by).agg(*[f(a).alias(f"{t}_{a}") for a in AXES for t, f in (("low", F.min), ("high", F.max))])


def is_grid() -> Column:
    """Whether a row has whole bounds and at least one voxel on every axis."""
    own = [F.coalesce((F.col(f"n_{a}") >= 1) & (F.col(f"high_{a}") > F.col(f"low_{a}")), F.lit(False)) for a in AXES]
    return own[0] & own[1] & own[2]


def centres(grids: DataFrame, by: list[str]) -> DataFrame:
    """Every voxel of each grid (bounds are outer edges) with its centre."""
    rows = _spread(grids, {v: F.col(f"n_{a}") for a, v in zip(AXES, VOXEL)})
    at = {a: F.col(f"low_{a}") + (F.col(v) + 0.5) * (F.col(f"high_{a}") - F.col(f"low_{a}")) / F.col(f"n_{a}") for a, v in zip(AXES, VOXEL)}
    return rows.select(*by, *VOXEL, *[v.alias(a) for a, v in at.items()])


def regular_points(grids: DataFrame, by: list[str], spacing: float, margins: bool = False) -> DataFrame:
    """Points every ``spacing`` within each box: centres of cells, or their margins."""
    shift = 0.0 if margins else spacing / 2
    counts = {v: F.floor((F.col(f"high_{a}") - F.col(f"low_{a}") - shift) / spacing + 1e-9) + 1 for a, v in zip(AXES, VOXEL)}
    rows = _spread(grids.where(" and ".join(f"high_{a} - low_{a} >= {shift}" for a in AXES)), counts)
    return rows.select(*by, *VOXEL, *[(F.col(f"low_{a}") + shift + F.col(v) * spacing).alias(a) for a, v in zip(AXES, VOXEL)])


def meshes(grids: DataFrame, by: list[str]) -> DataFrame:
    """``n`` points an axis from one bound of each box to the other."""
    rows = _spread(grids, {v: F.col(f"n_{a}") for a, v in zip(AXES, VOXEL)})
    step = {a: (F.col(f"high_{a}") - F.col(f"low_{a}")) / F.greatest(F.lit(1), F.col(f"n_{a}") - 1) for a in AXES}
    return rows.select(*by, *VOXEL, *[(F.col(f"low_{a}") + F.col(v) * step[a]).alias(a) for a, v in zip(AXES, VOXEL)])


def geometry_of(grids: DataFrame, by: list[str]) -> DataFrame:
    """Per axis: voxel size, outer edges, and centres of the first and last voxel, of grids whose bounds are such centres."""
    def axis(a):
        size = (F.col(f"high_{a}") - F.col(f"low_{a}")) / F.nullif(F.col(f"n_{a}") - 1, F.lit(0))
        return F.struct(F.lit(a).alias("axis"), size.alias("voxel"), (F.col(f"low_{a}") - size / 2).alias("low"), (F.col(f"high_{a}") + size / 2).alias("high"), F.col(f"low_{a}").alias("first"), F.col(f"high_{a}").alias("last"))

    return grids.select(*by, F.explode(F.array(*[axis(a) for a in AXES])).alias("g")).select(*by, "g.*")


def targets(rows: DataFrame, numbers: str, by: list[str]) -> DataFrame:
    """Grids from arrays of six numbers (sizes, voxel sizes; origin 0) or nine (origin of the first centre last); others null."""
    known = F.size(numbers).isin(6, 9)
    at = lambda i: F.when(known, F.get(numbers, F.lit(i)).cast("double"))
    out = []
    for i, a in enumerate(AXES):
        low = F.when(F.size(numbers) == 9, at(6 + i)).otherwise(F.when(known, F.lit(0.0))) - at(3 + i) / 2
        out += [at(i).cast("int").alias(f"n_{a}"), low.alias(f"low_{a}"), (low + at(i) * at(3 + i)).alias(f"high_{a}")]
    return rows.select(*by, *out)


def as_cube(values: DataFrame, place: str, count: int) -> DataFrame:
    """Voxels of a vector whose length is a cube, x fastest."""
    side = round(count ** (1 / 3))
    if side**3 != count:
        raise ValueError(f"{count} values are no cube")
    at = F.col(place)
    return values.withColumns({"i": (at % side).cast("int"), "j": (F.floor(at / side) % side).cast("int"), "k": F.floor(at / side**2).cast("int")})


def index_of(grid: Grid, axis: int, coordinate: Column, rounded: bool = True) -> Column:
    """1-based index of a coordinate among voxel centres, as a fraction unless rounded."""
    at = (coordinate - (grid.low[axis] + grid.voxel[axis] / 2)) / grid.voxel[axis]
    return F.rint(at).cast("int") + 1 if rounded else at + 1


#: Rows of cells (some 100 bytes each) that are broadcast to the points; more are met by a shuffled join.
HELD_CELLS = 1 << 18


def _stored(voxels: DataFrame, by: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Voxels, written once, and what to do with the cells that come of them before a join: a broadcast if they are few."""
    spark = voxels.sparkSession
    path = scratch(spark, "voxels")
    voxels.select(*by, *VOXEL, "value").write.parquet(path)
    kept = spark.read.parquet(path)
    return kept, (F.broadcast if 8 * kept.count() <= HELD_CELLS else lambda df: df)


def interpolated(points: DataFrame, voxels: DataFrame, grid: Grid, keys: list[str], by: list[str], method: str = "linear") -> DataFrame:
    """``value`` of each volume at points: of the voxel they are in, or weighted from the eight centres around.

    Absent voxels count as 0; points outside the box of centres get null (linear).
    """
    # keys travel as one column, as they may be named like voxel axes
    points = points.select(F.struct(*keys).alias("_key"), *AXES)
    voxels, near = _stored(voxels, by)
    volumes = F.broadcast(voxels.select(*by).distinct())
    inside = F.lit(True)
    own = [*by, *[F.col(f"_key.{k}").alias(k) for k in keys]]
    if method == "constant":
        at = points.withColumns({v: grid.index(a, F.col(c)) for a, (c, v) in enumerate(zip(AXES, VOXEL))})
        for v, n in zip(VOXEL, grid.n):
            inside = inside & F.col(v).between(0, n - 1)
        met = at.crossJoin(volumes).join(near(voxels), [*by, *VOXEL], "left")
        return met.withColumn("_v", F.when(inside, F.coalesce(F.col("value").cast("double"), F.lit(0.0)))).select(*own, F.col("_v").alias("value"))
    rows = points.withColumns({f"_{c}": (F.col(c) - (grid.low[a] + grid.voxel[a] / 2)) / grid.voxel[a] for a, c in enumerate(AXES)})
    for c, n in zip(AXES, grid.n):
        inside = inside & F.col(f"_{c}").between(0, n - 1)
    low = {c: F.least(F.floor(F.col(f"_{c}")), F.lit(n - 2)).cast("int") for c, n in zip(AXES, grid.n)}
    rows = rows.withColumn("_in", inside).withColumns({f"_c{c}": v for c, v in low.items()}).withColumns({f"_u{c}": F.col(f"_{c}") - v for c, v in low.items()})
    cell = [f"_c{c}" for c in AXES]
    met = rows.crossJoin(volumes).join(near(corner_values(voxels, grid, by)), [*by, *cell], "left")
    weights = [[1 - F.col(f"_u{c}"), F.col(f"_u{c}")] for c in AXES]
    total = sum((weights[0][o >> 2] * weights[1][o >> 1 & 1] * weights[2][o & 1] * F.coalesce(f"_v{o}", F.lit(0.0)) for o in range(8)), F.lit(0.0))
    return met.select(*own, F.when(F.col("_in"), total).alias("value"))


def corner_values(voxels: DataFrame, grid: Grid, by: list[str]) -> DataFrame:
    """For each cell between centres that has any, the values ``_v0`` .. ``_v7`` at its corners; ``_cx, _cy, _cz`` name it by its lowest.

    Voxels are spread to the cells that they are corners of, so that points meet one
    row a cell and are not multiplied.
    """
    corners = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_o")
    rows = voxels.select(*by, *VOXEL, F.col("value").cast("double").alias("value"), corners)
    shift = {"_cx": F.col("i") - F.shiftright("_o", 2), "_cy": F.col("j") - F.shiftright("_o", 1) % 2, "_cz": F.col("k") - F.col("_o") % 2}
    rows = rows.select(*by, *[v.cast("int").alias(c) for c, v in shift.items()], "_o", "value")
    for c, n in zip(shift, grid.n):
        rows = rows.where(F.col(c).between(min(0, n - 2), n - 2))
    return rows.groupBy(*by, *shift).agg(*[F.sum(F.when(F.col("_o") == o, F.col("value"))).alias(f"_v{o}") for o in range(8)])


def resampled(spark, voxels: DataFrame, grid: Grid, target: Grid, by: list[str], matrix: np.ndarray | None = None, method: str = "linear") -> DataFrame:
    """Volumes on another grid; ``matrix`` takes the target's places to the source's."""
    places = expanded(spark, target)
    if matrix is not None:
        from .geometry import transform_points

        places = transform_points(places, matrix)
    return interpolated(places, voxels, grid, VOXEL, by, method)


def shrunk(voxels: DataFrame, factor: tuple[int, int, int], by: list[str]) -> DataFrame:
    """Means over blocks of voxels (absent ones 0)."""
    block = factor[0] * factor[1] * factor[2]
    at = [F.floor(F.col(v) / f).cast("int").alias(v) for v, f in zip(VOXEL, factor)]
    return voxels.select(*by, *at, "value").groupBy(*by, *VOXEL).agg((F.sum("value") / block).alias("value"))


def merged(volumes: list[DataFrame], axis: str, sizes: list[int]) -> DataFrame:
    """Volumes one after another along an axis."""
    out, shift = None, 0
    for v, n in zip(volumes, sizes):
        moved = v.withColumn(axis, (F.col(axis) + shift).cast("int"))
        out, shift = moved if out is None else out.unionByName(moved), shift + n
    return out


def normalised_and_smoothed(voxels: DataFrame, grid: Grid, threshold: float, top: float, sigma: float, by: list[str]) -> DataFrame:
    """Values clamped to a range and brought to 0..1, then smoothed."""
    held = F.greatest(F.lit(threshold), F.least(F.lit(top), F.col("value")))
    return gaussian_smooth(voxels.withColumn("value", (held - threshold) / (top - threshold)), grid, sigma, 2.5, by)


def auto_cropped(voxels: DataFrame, grid: Grid, threshold: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Volumes cut to the voxels at or above a threshold, and each one's sizes and new origin."""
    kept = voxels.where(F.col("value") >= threshold)
    box = kept.groupBy(*by).agg(*[f(v).alias(f"{v}_{n}") for v in VOXEL for f, n in ((F.min, "min"), (F.max, "max"))])
    size = [(F.col(f"{v}_max") - F.col(f"{v}_min") + 1).alias(f"n{v}") for v in VOXEL]
    origin = [(grid.low[a] + (F.col(f"{v}_min") + 0.5) * grid.voxel[a]).alias(f"{c}0") for a, (v, c) in enumerate(zip(VOXEL, AXES))]
    return crop(voxels, box, by), box.select(*by, *size, *origin)


def labelled(voxels: DataFrame, materials: DataFrame, omit: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """1 where a voxel's material is kept, else 0; ``materials(id, name)``."""
    chosen = materials.where(F.col("name").isin(keep) if keep is not None else ~F.col("name").isin(omit or []))
    return voxels.join(F.broadcast(chosen.select(F.col("id").alias("value"), F.lit(1).alias("_kept"))), "value", "left").withColumn("value", F.coalesce("_kept", F.lit(0))).drop("_kept")


def flipped_or(masks: DataFrame, axis: str, n: int, by: list[str]) -> DataFrame:
    """The greater of each mask and its mirror image."""
    return combine(masks, flip(masks, axis, n), "max", [*by, *VOXEL])


# ----------------------------------------------------------------------- statistics
def statistics(voxels: DataFrame, mask: DataFrame | None, by: list[str]) -> DataFrame:
    """Least, greatest, mean, deviation, number, sum and entropy (natural, of values) of volumes, by mask label."""
    keys = list(by)
    if mask is not None:
        voxels, keys = voxels.join(mask.select(*VOXEL, F.col("value").alias("label")), VOXEL), [*by, "label"]
    levels = voxels.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    v, n = F.col("value").cast("double"), F.col("n")
    out = levels.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.sum(n).alias("n"), F.sum(v * n).alias("sum"), F.sum(v * v * n).alias("_s2"), F.sum(n * F.log(n)).alias("_nl"))
    mean = F.col("sum") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("_s2") - F.col("n") * mean * mean) / (F.col("n") - 1)))
    return out.select(*keys, "min", "max", mean.alias("mean"), F.when(F.col("n") > 1, sd).alias("sd"), "n", "sum", (F.log("n") - F.col("_nl") / F.col("n")).alias("entropy"))


def similarity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation, mean squared difference and mean product of two volumes over voxels that either has."""
    j = a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), keys, "full")
    x, y = F.coalesce("x", F.lit(0)).cast("double"), F.coalesce("y", F.lit(0)).cast("double")
    return j.agg(F.corr(x, y).alias("correlation"), F.avg((x - y) ** 2).alias("msd"), F.avg(x * y).alias("product"), F.count("*").alias("n"))


def deviations(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Sample standard deviation of each group, from sums in one pass."""
    return voxels.groupBy(*by).agg(F.stddev_samp("value").alias("sd"))


def weighted_histogram(voxels: DataFrame, mask: DataFrame | None, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    """Equal bins of values, counted or weighted by a mask."""
    w = F.lit(1.0)
    if mask is not None:
        voxels, w = voxels.join(mask.select(*VOXEL, F.col("value").cast("double").alias("_w")), VOXEL), F.col("_w")
    at = F.least(F.floor((F.col("value") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return voxels.where(F.col("value").between(low, high)).groupBy(*by, at.alias("bin")).agg(F.sum(w).alias("count"))


def stack_entropy(voxels: DataFrame, by: str, bins: int = 100) -> DataFrame:
    """For each voxel, the sum over volumes of ``-p log p``, p being the share of the volume's voxels in the value's bin."""
    span = voxels.groupBy(by).agg(F.min("value").alias("_l"), F.max("value").alias("_h"), F.count("*").alias("_n"))
    at = F.least(F.floor((F.col("value") - F.col("_l")) / F.nullif(F.col("_h") - F.col("_l"), F.lit(0)) * bins), F.lit(bins - 1))
    rows = voxels.join(F.broadcast(span), by).withColumn("_bin", F.coalesce(at, F.lit(0)).cast("int"))
    share = rows.groupBy(by, "_bin").agg((F.count("*") / F.first("_n")).alias("p"))
    return rows.join(share, [by, "_bin"]).groupBy(*VOXEL).agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def information_matrix(voxels: DataFrame, by: str, entropies, bins: int = 99) -> DataFrame:
    """Mutual-information distance of every ordered pair of different volumes; absent voxels are 0."""
    from .stats import mutual_information

    names = voxels.select(by).distinct()
    every = voxels.select(*VOXEL).distinct().crossJoin(F.broadcast(names)).join(voxels, [by, *VOXEL], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("double"))
    a, b = (every.select(*VOXEL, F.col(by).alias(f"id_{t}"), F.col("value").alias(t)) for t in "ab")
    pairs = a.join(b, VOXEL).where("id_a <> id_b").select(F.concat_ws("|", "id_a", "id_b").alias("pair"), "a", "b")
    out = mutual_information(entropies(pairs, bins))
    return out.select(F.substring_index("pair", "|", 1).alias("id_a"), F.substring_index("pair", "|", -1).alias("id_b"), "mi_distance")


def density_estimate(spark, points: DataFrame, grid: Grid, widths: tuple[float, float, float], by: list[str], weight: str | None = None) -> DataFrame:
    """Product-Gaussian density on a grid, summing to 1: points give each axis its weights, which are multiplied up."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = points.select(*by, *AXES, w.alias("_w"))
    for a, c in enumerate(AXES):
        rows = rows.withColumn(f"_g{c}", F.array(*[F.exp(-((F.col(c) - grid.centre(a, F.lit(i))) ** 2) / (2 * widths[a] ** 2)) for i in range(grid.n[a])]))
    # one axis at a time, adding up after each, so that rows stay points x voxels of one axis
    rows = rows.select("*", F.posexplode("_gx").alias("i", "_vx")).withColumn("_w", F.col("_w") * F.col("_vx"))
    rows = rows.select("*", F.posexplode("_gy").alias("j", "_vy")).withColumn("_w", F.col("_w") * F.col("_vy"))
    rows = rows.select("*", F.posexplode("_gz").alias("k", "_vz")).groupBy(*by, *VOXEL).agg(F.sum(F.col("_w") * F.col("_vz")).alias("value"))
    total = rows.groupBy(*by).agg(F.sum("value").alias("_t")) if by else rows.agg(F.sum("value").alias("_t"))
    joined = rows.join(F.broadcast(total), by) if by else rows.crossJoin(F.broadcast(total))
    return joined.select(*by, *VOXEL, (F.col("value") / F.col("_t")).alias("value"))


# ----------------------------------------------------------------- cumulative normal
def fit_normal(x: np.ndarray, share: np.ndarray, mu: float | None = None, sigma: float | None = None, rounds: int = 100) -> tuple[float, float]:
    """Mean and deviation of the normal distribution nearest (least squares) to a cumulative share.

    Starts from the median and the quartiles' distance over 1.349.
    """
    mu = float(np.interp(0.5, share, x)) if mu is None else mu
    sigma = float((np.interp(0.75, share, x) - np.interp(0.25, share, x)) / 1.349) if sigma is None else sigma
    sigma = sigma if sigma > 0 else 1.0
    cdf = lambda m, s: np.array([0.5 * (1 + math.erf((v - m) / (s * math.sqrt(2)))) for v in x])
    now, damp = cdf(mu, sigma) - share, 1e-3
    for _ in range(rounds):
        z = (x - mu) / sigma
        g = np.exp(-(z**2) / 2) / (sigma * math.sqrt(2 * math.pi))
        slope = np.stack([-g, -g * z], axis=1)
        square = slope.T @ slope
        step = np.linalg.solve(square + damp * np.diag(np.diag(square) + 1e-15), -slope.T @ now)
        m, s = mu + step[0], sigma + step[1]
        after = cdf(m, s) - share if s > 0 else now + 1
        if after @ after < now @ now:
            small = abs(step).max() < 1e-12 * max(1.0, abs(mu))
            mu, sigma, now, damp = m, s, after, damp / 4
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(mu), float(sigma)


def background(hist: DataFrame, by: str, truncate: float = 1.0) -> DataFrame:
    """Background mean, deviation and threshold (mean + 2 deviations) of histograms ``(by, bin, hi, count)``.

    The cumulative share, cut where it passes ``truncate`` if more than ten bins
    are left, is fitted with a normal distribution.  Histograms without counts
    give nulls.
    """
    kind = hist.schema[by].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bin")
        x, n = (t.column(c).to_numpy().astype(float) for c in ("hi", "count"))
        mu = sigma = None
        if n.sum() > 0 and len(x) > 1:
            share = np.cumsum(n) / n.sum()
            kept = share <= truncate
            if kept.sum() > 10:
                x, share = x[kept], share[kept] / share[kept][-1]
            mu, sigma = fit_normal(x, share)
        return pa.table({by: t.column(by).slice(0, 1), "mu": pa.array([mu], pa.float64()), "sigma": pa.array([sigma], pa.float64())})

    fitted = hist.select(by, "bin", "hi", "count").groupBy(by).applyInArrow(run, f"{by} {kind}, mu double, sigma double")
    return fitted.withColumn("threshold", F.col("mu") + 2 * F.col("sigma"))


def cumulative_corner(hist: DataFrame, by: str, slope: float = 1.0, span: float = 0.2) -> DataFrame:
    """Where the smoothed cumulative share of histograms ``(by, bin, hi, count)`` rises nearest to ``slope``, x brought to 0..1."""
    kind = hist.schema[by].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bin")
        x, n = (t.column(c).to_numpy().astype(float) for c in ("hi", "count"))
        share, scaled = np.cumsum(n) / max(1.0, n.sum()), (x - x[0]) / ((x[-1] - x[0]) or 1.0)
        reach = max(2, int(span * len(x)))
        smooth = np.zeros(len(x))
        for i in range(len(x)):  # local lines with tricube weights
            d = np.abs(scaled - scaled[i])
            h = np.sort(d)[min(reach, len(d) - 1)] or 1.0
            w = np.clip(1 - (d / h) ** 3, 0, 1) ** 3
            a = np.stack([np.ones(len(x)), scaled - scaled[i]], axis=1) * np.sqrt(w)[:, None]
            smooth[i] = np.linalg.lstsq(a, share * np.sqrt(w), rcond=None)[0][0]
        rise = np.diff(smooth) / np.maximum(np.diff(scaled), 1e-12)
        return pa.table({by: t.column(by).slice(0, 1), "x": pa.array([float(x[1:][np.abs(rise - slope).argmin()])])})

    return hist.select(by, "bin", "hi", "count").groupBy(by).applyInArrow(run, f"{by} {kind}, x double")


# ------------------------------------------------------------------------------ hulls
#: Points whose hull is found by looking at all triples at once.
FEW = 24


@lru_cache(maxsize=FEW)
def _triples(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 3)))


def _hull_of_few(p: np.ndarray, eps: float) -> np.ndarray | None:
    """The triples with all other points on one side; None where a facet holds more than three points."""
    i, j, k = _triples(len(p)).T
    normal = np.cross(p[j] - p[i], p[k] - p[i])
    reach = eps * np.linalg.norm(normal, axis=1)[:, None]
    side = normal @ p.T - (normal * p[i]).sum(axis=1)[:, None]
    above, below = (side > reach).any(axis=1), (side < -reach).any(axis=1)
    outer = np.flatnonzero(~(above & below))
    if ((np.abs(side[outer]) <= reach[outer]).sum(axis=1) > 3).any():
        return None
    flip = above[outer]
    return np.stack([p[i[outer]], p[np.where(flip, k[outer], j[outer])], p[np.where(flip, j[outer], k[outer])]], axis=1)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners (counter-clockwise from outside) of the triangles around a point set.

    Few points in general position are looked at in triples, others are added one at a time.
    """
    p = np.unique(np.asarray(points, dtype=float), axis=0)
    if len(p) < 4:
        return np.zeros((0, 3, 3))
    size = np.ptp(p, axis=0).max() or 1.0
    eps = 1e-9 * size
    if len(p) <= FEW and (found := _hull_of_few(p, eps)) is not None:
        return found
    a, b = p[p[:, 0].argmin()], p[p[:, 0].argmax()]
    line = np.linalg.norm(np.cross(p - a, b - a), axis=1)
    c = p[line.argmax()]
    normal = np.cross(b - a, c - a)
    away = (p - a) @ normal
    d = p[np.abs(away).argmax()]
    if line.max() <= eps * size or abs(away).max() <= eps * np.linalg.norm(normal):
        return np.zeros((0, 3, 3))
    centre = (a + b + c + d) / 4

    def facet(x, y, z):
        n = np.cross(y - x, z - x)
        n = n / np.linalg.norm(n)
        return ((x, y, z), n, n @ x) if n @ (centre - x) < 0 else ((x, z, y), -n, -n @ x)

    facets = [facet(a, b, c), facet(a, b, d), facet(a, c, d), facet(b, c, d)]
    for q in p[np.argsort(-((p - centre) ** 2).sum(axis=1))]:
        seen = np.stack([f[1] for f in facets]) @ q - np.array([f[2] for f in facets]) > eps
        if not seen.any():
            continue
        edges: dict[tuple, tuple] = {}
        for corners, hit in zip([f[0] for f in facets], seen):
            if hit:
                for u, v in ((0, 1), (1, 2), (2, 0)):
                    key = (corners[u].tobytes(), corners[v].tobytes())
                    if key[::-1] in edges:
                        del edges[key[::-1]]
                    else:
                        edges[key] = (corners[u], corners[v])
        facets = [f for f, hit in zip(facets, seen) if not hit]
        for u, v in edges.values():
            n = np.cross(v - u, q - u)
            if np.linalg.norm(n) > 0:
                facets.append(facet(u, v, q))
    return np.array([f[0] for f in facets])


def hull_measures(points: DataFrame, by: str) -> DataFrame:
    """Volume, surface and number of corners of each point set's hull (0 where points are flat or fewer than four).

    Points that lie on a facet may count as corners.
    """
    kind = points.schema[by].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        h = convex_hull(np.stack([t.column(c).to_numpy() for c in AXES], axis=1))
        cross = np.cross(h[:, 1] - h[:, 0], h[:, 2] - h[:, 0]) if len(h) else np.zeros((0, 3))
        volume = abs(float((h[:, 0] * cross).sum() / 6)) if len(h) else 0.0
        corners = len(np.unique(h.reshape(-1, 3), axis=0)) if len(h) else 0
        return pa.table({by: t.column(by).slice(0, 1), "volume": pa.array([volume]), "area": pa.array([float(np.linalg.norm(cross, axis=1).sum() / 2)]), "corners": pa.array([corners], pa.int32())})

    rows = points.where("x is not null and y is not null and z is not null")
    return rows.select(by, *AXES).distinct().groupBy(by).applyInArrow(run, f"{by} {kind}, volume double, area double, corners int")


def hull_planes(points: DataFrame, by: str) -> DataFrame:
    """Outward planes ``a x + b y + c z + d = 0`` of each hull."""
    kind = points.schema[by].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        h = convex_hull(np.stack([t.column(c).to_numpy() for c in AXES], axis=1))
        n = np.cross(h[:, 1] - h[:, 0], h[:, 2] - h[:, 0]) if len(h) else np.zeros((0, 3))
        n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
        d = -(n * h[:, 0]).sum(axis=1) if len(h) else np.zeros(0)
        planes = np.c_[n, d][np.unique(np.round(np.c_[n, d], 9), axis=0, return_index=True)[1]]
        return pa.table({by: pa.array([t.column(by)[0].as_py()] * len(planes), t.schema.field(by).type), **{c: pa.array(planes[:, i]) for i, c in enumerate("abcd")}})

    return points.select(by, *AXES).distinct().groupBy(by).applyInArrow(run, f"{by} {kind}, a double, b double, c double, d double")


def inside_hull(points: DataFrame, planes: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Points no further than 1e-6 outside any plane of their set's hull."""
    out = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")
    return points.join(planes, by).groupBy(by, *keys).agg((F.max(out) <= 1e-6).alias("inside"))


def hull_overlap(one: DataFrame, two: DataFrame, by: str) -> DataFrame:
    """Volumes of two sets' hulls less that of the hull around both: ``overlap``, and as a share of the first and of both.

    Sets whose hulls are apart get a negative overlap, as the hull around both spans the gap.
    """
    both = one.select(by, *AXES).unionByName(two.select(by, *AXES))
    parts = [hull_measures(points, by).select(by, F.col("volume").alias(n)) for n, points in (("v1", one), ("v2", two), ("v12", both))]
    met = parts[0].join(parts[1], by).join(parts[2], by)
    overlap = F.col("v1") + F.col("v2") - F.col("v12")
    share = lambda whole: overlap / F.nullif(whole, F.lit(0.0))
    return met.select(by, overlap.alias("overlap"), share(F.col("v1")).alias("of_first"), share(F.col("v1") + F.col("v2")).alias("of_both"), "v1", "v2", "v12")


def hull_2d(xy: np.ndarray) -> np.ndarray:
    """Places of the corners of a flat point set's hull, in the set's order; points on an edge are no corners."""
    order = np.lexsort((xy[:, 1], xy[:, 0]))
    order = order[np.r_[True, (np.diff(xy[order], axis=0) != 0).any(axis=1)]] if len(order) else order
    if len(order) < 3:
        return np.sort(order)

    def half(places):
        out: list[int] = []
        for p in places:
            while len(out) > 1 and np.linalg.det([xy[out[-1]] - xy[out[-2]], xy[p] - xy[out[-2]]]) <= 0:
                out.pop()
            out.append(int(p))
        return out

    return np.unique(half(order) + half(order[::-1]))


def contours(points: DataFrame, by: str, contour: str, number: str, least: int = 5, thin: bool = True) -> DataFrame:
    """Contours of each ``by`` along z: ``place`` numbers all their points by z, then contour, then order.

    Contours of fewer than ``least`` points are left out; ``thin`` keeps the corners of
    each one's hull in x and y only.
    """
    from pyspark.sql import Window

    rows = points.where("x is not null and y is not null and z is not null").select(by, contour, number, *AXES)
    if thin:
        kept = outlines(rows, [by, contour], number, least).drop("place")
    else:
        kept = rows.withColumn("_n", F.count("*").over(Window.partitionBy(by, contour))).where(F.col("_n") >= least).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("z", contour, number)))


def outlines(points: DataFrame, by: list[str], number: str, least: int = 3) -> DataFrame:
    """Contours thinned to the corners of their hull in x and y, in their own order, as ``place`` from 1.

    Points without all coordinates and contours of fewer than ``least`` points are left out.
    """
    kinds = {c: points.schema[c].dataType.simpleString() for c in (*by, number)}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(number)
        xyz = np.stack([t.column(c).to_numpy().astype(float) for c in AXES], axis=1)
        kept = hull_2d(xyz[:, :2]) if len(xyz) >= least else np.zeros(0, dtype=np.int64)
        own = t.take(pa.array(kept, pa.int64()))
        return pa.table({**{c: own.column(c) for c in (*by, number)}, "place": pa.array(np.arange(1, len(kept) + 1), pa.int32()), **{c: pa.array(xyz[kept, i]) for i, c in enumerate(AXES)}})

    rows = points.where("x is not null and y is not null and z is not null").select(*by, number, *AXES)
    return rows.groupBy(*by).applyInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", place int, x double, y double, z double")


# -------------------------------------------------------------------------------- ICA
def component_mask(voxels: DataFrame, share: float = 0.1) -> DataFrame:
    """Voxels whose sum over volumes is at least a share of the greatest such sum."""
    sums = voxels.groupBy(*VOXEL).agg(F.sum("value").alias("total"))
    top = sums.agg(F.max("total").alias("_top"))
    return sums.crossJoin(F.broadcast(top)).select(*VOXEL, (F.col("total") >= share * F.col("_top")).cast("int").alias("value"))


def independent_components(voxels: DataFrame, by: str, n: int, seed: int = 1, rounds: int = 500) -> tuple[np.ndarray, DataFrame]:
    """Unmixing matrix and ``component, i, j, k, value`` of volumes seen as mixtures.

    Voxels are written once with a column for each volume, and once whitened to
    ``n`` columns.  Each round of the fixed-point iteration (log cosh, symmetric) is
    one aggregation of moments over them; the driver holds matrices of a row and a
    column for each volume or component, never voxels.
    """
    from arborkit.sources.files import scratch

    spark = voxels.sparkSession
    names = sorted(x[0] for x in voxels.select(by).distinct().collect())
    path = scratch(spark, "wide-voxels")
    voxels.groupBy(*VOXEL).pivot(by, names).agg(F.sum("value").cast("double")).na.fill(0.0).toDF(*VOXEL, *[f"_x{i}" for i in range(len(names))]).write.parquet(path)
    wide = spark.read.parquet(path)
    x = [F.col(f"_x{i}") for i in range(len(names))]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = wide.agg(*[F.avg(c) for c in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs]).first()
    mean, cov = np.array(sums[: len(x)], dtype=float), np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, sums[len(x) :]):
        cov[i, j] = cov[j, i] = v
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:n]
    white = (vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))).T
    mixed = lambda rows, cols: [sum((float(w) * c for w, c in zip(row, cols)), F.lit(0.0)) for row in rows]
    path = scratch(spark, "white-voxels")
    wide.select(*[c.alias(f"_z{i}") for i, c in enumerate(mixed(white, [c - float(m) for c, m in zip(x, mean)]))]).write.parquet(path)
    z, whitened = [F.col(f"_z{i}") for i in range(n)], spark.read.parquet(path)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
    for _ in range(rounds):
        bent = whitened.select(*z, *[F.tanh(c).alias(f"_g{i}") for i, c in enumerate(mixed(w, z))])
        g = [F.col(f"_g{i}") for i in range(n)]
        moments = np.array(bent.agg(*[F.avg(a * b) for a in g for b in z], *[F.avg(1 - a * a) for a in g]).first(), dtype=float)
        new = moments[: n * n].reshape(n, n) - moments[n * n :, None] * w
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-10
        w = new
        if done:
            break
    unmix = w @ white
    unmix = unmix * np.where(unmix[np.arange(n), np.abs(unmix).argmax(axis=1)] < 0, -1, 1)[:, None]
    rows = wide.select(*VOXEL, F.posexplode(F.array(*mixed(unmix, x))).alias("component", "value"))
    return unmix, rows
