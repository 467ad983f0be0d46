"""Choosing points, neurons and types: by region, by predicate, by reference; orientation of axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import KEY, point_classes


def points_in_region(segments: DataFrame, kinds: DataFrame, region: int | None = None) -> DataFrame:
    """Points of one region's segments, or of all; ``kinds`` has a segment's region as ``kind``."""
    if region is not None:
        segments = segments.join(kinds.where(F.col("kind") == region).select(KEY, "seg_no"), [KEY, "seg_no"], "left_semi").where("tree_no = 1")
    return segments.select(KEY, "point_no").distinct()


def of_kind(points: DataFrame, chosen: DataFrame, which: tuple[str, ...] = ("end", "branch")) -> DataFrame:
    kinds = point_classes(points).where(F.col("kind").isin(*which)).select(KEY, "point_no", "kind")
    return kinds.join(chosen, [KEY, "point_no"], "left_semi")


def matching_neurons(points: DataFrame, predicate: Column, ends_only: bool = True) -> DataFrame:
    """Neurons with a point (or end point) that meets a predicate, and those points in order."""
    rows = point_classes(points)
    if ends_only:
        rows = rows.where("kind = 'end' or kind = 'root'")
    return rows.where(predicate).groupBy(KEY).agg(F.array_sort(F.collect_list("point_no")).alias("points"), F.count("*").alias("n"))


def by_reference(neurons: DataFrame, reference: int | str, name: str = "name") -> DataFrame:
    """One neuron by its number (from 1, in order of id) or its name."""
    if isinstance(reference, str):
        return neurons.where(F.upper(name) == reference.upper())
    return neurons.orderBy(KEY).offset(reference - 1).limit(1)


def names_of(neurons: DataFrame, numbers: DataFrame, key: str = KEY) -> DataFrame:
    """Names and types of the neurons that a table of references lists; unknown ones stay with nulls."""
    return numbers.join(neurons, key, "left")


def real_axes(corners: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """Axis order and signs from two corner markers and the spans of a neuron's coordinates.

    ``corners(by, mx, my, mz, lx, ly, lz)``: the medial and the lateral corner;
    ``spans(by, x_min, x_max, ..)``.  The medio-lateral axis is the one on which
    the corners differ most (the first of equals); x and y change places where
    that is y.  Signs make medial less than lateral, ventral nearer the least and
    anterior nearer the greatest value.
    """
    d = {a: F.abs(F.col("m" + a) - F.col("l" + a)) for a in "xyz"}
    top = F.greatest(*d.values())
    swap = (d["x"] < top) & (d["y"] == top)
    low = lambda a: F.abs(F.col(f"{a}_min") - F.col("m" + a))
    high = lambda a: F.abs(F.col(f"{a}_max") - F.col("m" + a))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    across = {a: sign(F.col("m" + a) < F.col("l" + a)) for a in "xy"}
    down = {a: sign(low(a) < high(a)) for a in "xy"}
    joined = corners.join(spans, by)
    return joined.select(by, swap.alias("swap"), F.when(swap, down["x"]).otherwise(across["x"]).alias("sx"), F.when(swap, across["y"]).otherwise(down["y"]).alias("sy"), sign(low("z") > high("z")).alias("sz"))


def orient(points: DataFrame, axes: DataFrame, by: str) -> DataFrame:
    """Coordinates with the signs and the order of :func:`real_axes`; without a row they stay."""
    joined = points.join(axes, by, "left")
    scaled = {a: F.col(a) * F.coalesce("s" + a, F.lit(1)) for a in "xyz"}
    swapped = F.coalesce("swap", F.lit(False))
    x, y = F.when(swapped, scaled["y"]).otherwise(scaled["x"]), F.when(swapped, scaled["x"]).otherwise(scaled["y"])
    return joined.withColumns({"x": x, "y": y, "z": scaled["z"]}).drop("swap", "sx", "sy", "sz")


def merge_fields(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``target`` with the columns that only ``source`` has, and its own nulls filled from ``source``."""
    both = [c for c in source.columns if c in target.columns and c != key]
    more = [c for c in source.columns if c not in target.columns]
    s = source.select(key, *[F.col(c).alias(f"_s_{c}") for c in both], *more)
    joined = target.join(s, key, "left")
    return joined.select(key, *[F.coalesce(c, f"_s_{c}").alias(c) if c in both else F.col(c) for c in target.columns if c != key], *more)


def fill_from(table: DataFrame, sheet: DataFrame, key: str, column: str, valid: list[str]) -> DataFrame:
    """``column`` where it holds a valid value, else what the sheet has for the key."""
    other = sheet.groupBy(key).agg(F.min(column).alias("_other"))
    joined = table.join(other, key, "left")
    return joined.withColumn(column, F.when(F.col(column).isin(*valid), F.col(column)).otherwise(F.coalesce("_other", column))).drop("_other")


def changed_or_new(images: DataFrame, known: DataFrame, key: str = "image", digest: str = "md5") -> DataFrame:
    """Images that are not known, or known with another digest."""
    return images.join(known.select(key, digest), [key, digest], "left_anti")


def spliced(known: DataFrame, fresh: DataFrame, images: DataFrame, key: str = "image") -> DataFrame:
    """Known rows of images that are still there and were not recomputed, and the fresh ones."""
    kept = known.join(fresh.select(key), key, "left_anti").join(images.select(key), key, "left_semi")
    return kept.unionByName(fresh.select(*known.columns))
