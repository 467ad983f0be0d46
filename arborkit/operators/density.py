"""Voxel tables ``(density_id, i, j, k, value)``: binning, thresholds, boxes, algebra."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOXEL = ["i", "j", "k"]


@dataclass(frozen=True)
class Grid:
    """``n`` voxels per axis between outer edges ``low`` and ``high``."""

    n: tuple[int, int, int]
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def voxel(self) -> tuple[float, ...]:
        return tuple((h - l) / n for n, l, h in zip(self.n, self.low, self.high))

    @property
    def bounding_box(self) -> list[tuple[float, float]]:
        """Voxel centres of the first and last voxel of each axis."""
        return [(l + d / 2, h - d / 2) for l, h, d in zip(self.low, self.high, self.voxel)]

    def index(self, axis: int, coordinate: Column) -> Column:
        """0-based voxel of a coordinate (half-open voxels)."""
        return F.floor((coordinate - self.low[axis]) / self.voxel[axis]).cast("int")

    def centre(self, axis: int, index: Column) -> Column:
        return self.low[axis] + (index + 0.5) * self.voxel[axis]


def bin3d(points: DataFrame, grid: Grid, by: list[str], upper: str = "drop") -> DataFrame:
    """Point counts per voxel; points on an upper bound vanish unless ``include``."""
    kept = points
    for axis, c in enumerate("xyz"):
        kept = kept.where(F.col(c).between(grid.low[axis], grid.high[axis]) if upper == "include" else (F.col(c) >= grid.low[axis]) & (F.col(c) < grid.high[axis]))
    at = [F.least(grid.index(a, F.col(c)), F.lit(grid.n[a] - 1)).alias(v) for a, (c, v) in enumerate(zip("xyz", VOXEL))]
    return kept.select(*by, *at).groupBy(*by, *VOXEL).agg(F.count("*").alias("value"))


def integrate(voxels: DataFrame, grid: Grid, by: list[str]) -> DataFrame:
    """Sum of value times voxel volume."""
    dx, dy, dz = grid.voxel
    return voxels.groupBy(*by).agg((F.sum("value") * (dx * dy * dz)).alias("integral"))


def cumulative_threshold(voxels: DataFrame, fraction: float, by: list[str]) -> DataFrame:
    """The value at which the descending cumulative sum first reaches ``fraction`` of the total.

    Equal values are added up before the running sum, so the window sees one row
    per distinct value.
    """
    levels = voxels.groupBy(*by, "value").agg(F.sum("value").alias("mass"))
    down = Window.partitionBy(*by).orderBy(F.col("value").desc())
    run = levels.withColumn("cum", F.sum("mass").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("mass").over(Window.partitionBy(*by)))
    return run.where(F.col("cum") >= fraction * F.col("total")).groupBy(*by).agg(F.max("value").alias("threshold"))


def bounding_box(voxels: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Smallest index box of voxels above a threshold."""
    return voxels.where(F.col("value") > threshold).groupBy(*by).agg(*[f(v).alias(f"{v}_{n}") for v in VOXEL for f, n in ((F.min, "min"), (F.max, "max"))])


def crop(voxels: DataFrame, box: DataFrame, by: list[str]) -> DataFrame:
    inside = voxels.join(box, by)
    for v in VOXEL:
        inside = inside.where(F.col(v).between(F.col(f"{v}_min"), F.col(f"{v}_max")))
    return inside.select(*by, *[(F.col(v) - F.col(f"{v}_min")).alias(v) for v in VOXEL], "value")


def blend(voxels: DataFrame, weights: DataFrame, scale: float = 1.0) -> DataFrame:
    """``weights(output, density_id, weight)``: weighted sums of volumes."""
    return voxels.join(weights, "density_id").groupBy("output", *VOXEL).agg((F.sum(F.col("value") * F.col("weight")) * scale).alias("value"))


#: Measures of a projection along one axis.
MEASURES = {
    "min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "median": lambda c: F.percentile(c, F.lit(0.5)), "variance": F.var_pop, "sd": F.stddev_pop,
    "product": F.product, "l1": lambda c: F.sum(F.abs(c)), "l2": lambda c: F.sqrt(F.sum(F.col(c) ** 2)), "linf": lambda c: F.max(F.abs(c)), "skew": F.skewness, "mode": lambda c: F.mode(c, True), "count": F.count,
}
#: Measures that go by the place along the axis.
PLACED = {"first": F.min_by, "last": F.max_by, "slope": F.regr_slope, "intercept": F.regr_intercept}


def project(voxels: DataFrame, axis: str, measure: str, by: list[str]) -> DataFrame:
    """One value a line along ``axis``; of equally frequent values ``mode`` is the least."""
    if measure not in MEASURES and measure not in PLACED:
        raise ValueError(f"unknown measure {measure}")
    value = PLACED[measure]("value", axis) if measure in PLACED else MEASURES[measure]("value")
    return voxels.groupBy(*by, *[v for v in VOXEL if v != axis]).agg(value.alias("value"))


def combine(a: DataFrame, b: DataFrame, operation: str, keys: list[str]) -> DataFrame:
    """Voxelwise max, min, +, -, * or / of two volumes; missing voxels are 0."""
    x, y = F.coalesce("a", F.lit(0)).cast("double"), F.coalesce("b", F.lit(0)).cast("double")
    how = {"max": F.greatest(x, y), "min": F.least(x, y), "+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[operation]
    joined = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), keys, "full")
    return joined.select(*keys, how.alias("value"))


def flip(voxels: DataFrame, axis: str, n: int) -> DataFrame:
    return voxels.withColumn(axis, F.lit(n - 1) - F.col(axis))


def quantize(voxels: DataFrame, low: float, high: float, bits: int = 8) -> DataFrame:
    """Clamp to ``low..high`` and scale to integers of ``bits``."""
    top = 2**bits - 1
    return voxels.withColumn("value", F.floor((F.greatest(F.lit(low), F.least(F.lit(high), F.col("value"))) - low) / (high - low) * top + 0.5).cast("long"))


def simplify_labels(voxels: DataFrame, kept: list[int]) -> DataFrame:
    return voxels.withColumn("value", F.col("value").isin(kept).cast("int"))


def gaussian_smooth(voxels: DataFrame, grid: Grid, sigma: float, sds: float = 4.0, by: list[str] | None = None) -> DataFrame:
    """Separable Gaussian smoothing: three sparse passes, one axis each."""
    import math

    by = by or []
    out = voxels.withColumn("value", F.col("value").cast("double"))
    reach = max(1, math.ceil(sds * max(math.ceil(sigma / d) for d in grid.voxel)))
    for axis, v in enumerate(VOXEL):
        weights = [math.exp(-((o * grid.voxel[axis]) ** 2) / (2 * sigma**2)) for o in range(-reach, reach + 1)]
        total = sum(weights)
        taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / total).alias("w")) for o, w in zip(range(-reach, reach + 1), weights)])
        spread = out.withColumn("t", F.explode(taps)).withColumn(v, F.col(v) + F.col("t.o")).withColumn("value", F.col("value") * F.col("t.w"))
        out = spread.where(F.col(v).between(0, grid.n[axis] - 1)).groupBy(*by, *VOXEL).agg(F.sum("value").alias("value"))
    return out
