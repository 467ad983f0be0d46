"""Operators along segments: seglets, lengths, midpoints, resampling, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "neuron_id"


def seglets(points: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Straight pieces from each point's parent (x0..) to the point (x1..), and ``more`` columns of both ends."""
    child = points.where("parent <> -1").select(KEY, "point_no", "parent", *[F.col(a).alias(a + "1") for a in (*"xyz", *more)])
    head = points.select(KEY, F.col("point_no").alias("parent"), *[F.col(a).alias(a + "0") for a in (*"xyz", *more)])
    return child.join(head, [KEY, "parent"]).withColumn("len", F.sqrt(sum(((F.col(a + "1") - F.col(a + "0")) ** 2 for a in "xyz"), F.lit(0.0))))


def arbour_length(pieces: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pieces.groupBy(*(by or [KEY])).agg(F.sum("len").alias("length"), F.count("*").alias("n_seglets"))


def midpoints(pieces: DataFrame) -> DataFrame:
    return pieces.select(KEY, "point_no", *[((F.col(a + "0") + F.col(a + "1")) / 2).alias(a) for a in "xyz"], F.col("len").alias("weight"))


def fraction_below(pieces: DataFrame, limit: float = 0.49, comparator: str = "<") -> DataFrame:
    """Share of seglets whose length compares so with ``limit``."""
    held = {"<": F.col("len") < limit, "<=": F.col("len") <= limit, ">": F.col("len") > limit, ">=": F.col("len") >= limit, "==": F.col("len") == limit}[comparator]
    return pieces.groupBy(KEY).agg(F.avg(F.when(held, 1.0).otherwise(0.0)).alias("fraction"))


def polyline(points: DataFrame) -> DataFrame:
    """Adds ``s``: distance along the points in ``point_no`` order."""
    w = Window.partitionBy(KEY).orderBy("point_no")
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in "xyz"), F.lit(0.0)))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def resample(points: DataFrame, step: float) -> DataFrame:
    """Points every ``step`` of arc length, the first and last point kept.

    Each piece generates the positions that fall on it, so nothing is joined.
    """
    w = Window.partitionBy(KEY).orderBy("point_no")
    line = polyline(points).select(KEY, "point_no", *"xyz", "s", F.lead("s").over(w).alias("s1"), *[F.lead(a).over(w).alias(a + "1") for a in "xyz"])
    first = F.ceil(F.col("s") / step)
    last = F.ceil(F.col("s1") / step) - 1
    spots = F.when(F.col("s1").isNotNull() & (last >= first), F.transform(F.sequence(first, last), lambda i: i * step))
    made = line.select("*", F.explode(spots).alias("at"))
    share = F.try_divide(F.col("at") - F.col("s"), F.col("s1") - F.col("s"))
    inner = made.select(KEY, F.col("at").alias("s"), *[(F.col(a) + share * (F.col(a + "1") - F.col(a))).alias(a) for a in "xyz"])
    end = line.where("s1 is null").select(KEY, "s", *"xyz")
    return inner.unionByName(end)


def moving_average(points: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Weighted three-point filter along each polyline; its ends stay."""
    total = sum(weights)
    w = Window.partitionBy(KEY).orderBy("point_no")
    smooth = {}
    for a in "xyz":
        before, after = F.lag(a).over(w), F.lead(a).over(w)
        mixed = (weights[0] * before + weights[1] * F.col(a) + weights[2] * after) / total
        smooth[a] = F.coalesce(mixed, F.col(a))
    return points.withColumns(smooth)


def line_pairs(points: DataFrame) -> DataFrame:
    """Points as the ends of separate line pieces: all but the first and last twice, ``pos`` in order."""
    w = Window.partitionBy(KEY).orderBy("point_no")
    pieces = points.select(KEY, "point_no", *"xyz", F.lead(F.struct("point_no", *"xyz")).over(w).alias("_next"), (F.row_number().over(w) - 1).alias("_n")).where("_next is not null")
    ends = F.posexplode(F.array(F.struct("point_no", *"xyz"), F.col("_next"))).alias("_end", "_p")
    return pieces.select(KEY, "_n", ends).select(KEY, (2 * F.col("_n") + F.col("_end")).alias("pos"), "_p.*")


def line_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of ``l d^2 + l^3 / 6 (1 - cos theta)`` over index-aligned polylines."""
    w = Window.partitionBy(KEY).orderBy("point_no")

    def pieces(df, tag):
        d = {c: F.lead(c).over(w) - F.col(c) for c in "xyz"}
        return df.select(KEY, "point_no", *[F.col(c).alias(f"{tag}{c}") for c in "xyz"], *[d[c].alias(f"{tag}d{c}") for c in "xyz"])

    j = pieces(a, "p").join(pieces(b, "q"), [KEY, "point_no"]).where("pdx is not null and qdx is not null")
    length = F.sqrt(sum((F.col(f"pd{c}") ** 2 for c in "xyz"), F.lit(0.0)))
    other = F.sqrt(sum((F.col(f"qd{c}") ** 2 for c in "xyz"), F.lit(0.0)))
    cosine = F.coalesce(F.try_divide(sum((F.col(f"pd{c}") * F.col(f"qd{c}") for c in "xyz"), F.lit(0.0)), length * other), F.lit(1.0))
    gap = sum(((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return j.groupBy(KEY).agg(F.sum(length * gap + length**3 / 6 * (1 - cosine)).alias("mismatch"))
