"""Coordinates inside lines of text, and lists of files by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"
#: A bracket (or line start), then three numbers.
PLACE = rf"^(\s*\(?\s*)({NUMBER})(\s+)({NUMBER})(\s+)({NUMBER})(.*)$"


def coordinates(lines: DataFrame, column: str) -> DataFrame:
    """Adds ``x, y, z``, the first three numbers of a line; null where a line does not begin with them."""
    return lines.withColumns({a: F.regexp_extract(column, PLACE, n).try_cast("double") for a, n in zip("xyz", (2, 4, 6))})


def rewritten(lines: DataFrame, column: str) -> DataFrame:
    """Lines with their numbers replaced by ``x, y, z`` (six decimals), all else as it was."""
    part = lambda n: F.regexp_extract(column, PLACE, n)
    at = lambda a: F.format_string("%.6f", F.col(a))
    new = F.concat(part(1), at("x"), part(3), at("y"), part(5), at("z"), part(7))
    return lines.withColumn(column, F.when(F.col("x").isNotNull(), new).otherwise(F.col(column)))


def scaled_axes(points: DataFrame, scale: tuple[float, float, float], shift: tuple[float, float, float], shift_last: bool = False) -> DataFrame:
    """``s (d + x)`` on every axis, or ``d + s x``."""
    return points.withColumns({a: d + s * F.col(a) if shift_last else s * (d + F.col(a)) for a, s, d in zip("xyz", scale, shift)})


def _turned_axes(how: str, centre: tuple[float, float]) -> dict[str, Column]:
    cx, cy = centre
    dx, dy = F.col("x") - cx, F.col("y") - cy
    x, y = {"h": (cx - dx, F.col("y")), "v": (F.col("x"), cy - dy), "l": (cx + dy, cy - dx), "r": (cx - dy, cy + dx)}[how]
    return {"x": x, "y": y}


def turned(points: DataFrame, how: str, centre: tuple[float, float]) -> DataFrame:
    """Mirrored (``h``, ``v``) or turned by a right angle (``l``, ``r``) about an image's centre."""
    return points.withColumns(_turned_axes(how, centre))


def turned_each(points: DataFrame, hows: str, centre: tuple[float, float]) -> DataFrame:
    """:func:`turned` in several ways, a row for each with ``how``; the points are made once."""
    ways = F.array(*[F.struct(F.lit(how).alias("how"), *[c.alias(n) for n, c in _turned_axes(how, centre).items()]) for how in hows])
    rows = points.withColumn("_way", F.explode(ways))
    return rows.withColumns({n: F.col(f"_way.{n}") for n in ("how", "x", "y")}).drop("_way")


def file_lists(scores: DataFrame, paths: DataFrame, by: str, most: int) -> DataFrame:
    """For each class the first ``most`` brains by score that have a file, and the first file of each.

    ``paths(place, path, brain)`` and ``scores(score, brain, by)``.
    """
    first = paths.groupBy("brain").agg(F.min_by("path", "place").alias("path"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("score", "brain"))
    return scores.join(first, "brain").withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def without_comments(lines: DataFrame, column: str, mark: str = "#") -> DataFrame:
    """Lines that are not blank and do not begin with a comment mark."""
    text = F.ltrim(column)
    return lines.where((text != "") & ~text.startswith(mark))


def path_and_score(lines: DataFrame, column: str) -> DataFrame:
    """``path, score`` of lines that hold both, separated by white space."""
    return lines.withColumns({"path": F.regexp_extract(column, r"^(\S+)\s+\S+\s*$", 1), "score": F.regexp_extract(column, r"^\S+\s+(\S+)\s*$", 1).try_cast("double")})
