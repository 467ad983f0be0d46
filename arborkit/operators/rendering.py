"""What drawing programs need of neurons, volumes and clusterings, as tables and scene texts.

Nothing is drawn here: scenes are lines of text made by string expressions, one
row a shape, which :func:`scenes` joins into a file a neuron.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .density import VOXEL
from .tree import KEY

#: The classic palette of a program without one, by number from 1.
PALETTE = ("red", "green", "blue", "purple", "cyan", "yellow")


def vector(*parts: Column) -> Column:
    return F.format_string("<%.6f,%.6f,%.6f>", *[p.cast("double") for p in parts])


def _at(end: str) -> Column:
    return vector(*[F.col(a + end) for a in "xyz"])


def cylinders(pieces: DataFrame, colour: str = "Red", width: str = "w") -> DataFrame:
    """A cylinder a seglet, as wide as its point."""
    text = F.concat(F.lit("cylinder { "), _at("0"), F.lit(", "), _at("1"), F.format_string(", %.6f pigment { color %s } }", F.col(width) / 2, F.lit(colour)))
    return pieces.select(KEY, "point_no", text.alias("line"))


def cones(pieces: DataFrame, colour: str = "Red") -> DataFrame:
    """A cone a seglet between the widths ``w0`` and ``w1`` of its ends."""
    text = F.concat(F.lit("cone { "), _at("0"), F.format_string(", %.6f, ", F.col("w0") / 2), _at("1"), F.format_string(", %.6f pigment { color %s } }", F.col("w1") / 2, F.lit(colour)))
    return pieces.select(KEY, "point_no", text.alias("line"))


def blended_cones(before: DataFrame, after: DataFrame, colour: str = "Red") -> DataFrame:
    """Cones that move from one shape to another with the scene's clock."""
    gap = lambda end: vector(*[F.col(f"b.{a}{end}") - F.col(f"a.{a}{end}") for a in "xyz"])
    start = lambda end: vector(*[F.col(f"a.{a}{end}") for a in "xyz"])
    j = before.alias("a").join(after.alias("b"), [KEY, "point_no"])
    return j.select(KEY, "point_no", _moving_cone(start, gap, F.col("a.w0"), F.col("a.w1"), colour).alias("line"))


def _moving_cone(start, gap, first: Column, last: Column, colour: str) -> Column:
    return F.concat(F.lit("cone { "), start("0"), F.lit("+clock*"), gap("0"), F.format_string(", %.6f, ", first / 2), start("1"), F.lit("+clock*"), gap("1"), F.format_string(", %.6f pigment { color %s } }", last / 2, F.lit(colour)))


def moved_cones(pieces: DataFrame, after: dict[str, Column], colour: str = "Red") -> DataFrame:
    """:func:`blended_cones` to shapes whose ends, as far as they differ, are expressions (``x0`` .. ``z1``) of the same row: no join."""
    gap = lambda end: vector(*[after.get(a + end, F.col(a + end)) - F.col(a + end) for a in "xyz"])
    return pieces.select(KEY, "point_no", _moving_cone(_at, gap, F.col("w0"), F.col("w1"), colour).alias("line"))


def spheres(points: DataFrame, keys: list[str], radius: str = "1", colour: str | Column = "Red") -> DataFrame:
    """A sphere a point."""
    paint = F.lit(colour) if isinstance(colour, str) else colour
    text = F.concat(F.lit("sphere { "), vector(*[F.col(a) for a in "xyz"]), F.format_string(", %s pigment { color %s } }", F.lit(radius), paint))
    return points.select(*keys, text.alias("line"))


def moving_spheres(before: DataFrame, after: DataFrame, keys: list[str], radius: str = "0.5", colour: str = "Red") -> DataFrame:
    j = before.alias("a").join(after.alias("b"), keys)
    gap = vector(*[F.col(f"b.{a}") - F.col(f"a.{a}") for a in "xyz"])
    text = F.concat(F.lit("sphere { "), vector(*[F.col(f"a.{a}") for a in "xyz"]), F.lit(f", {radius} translate clock*"), gap, F.lit(f" pigment {{ color {colour} }} }}"))
    return j.select(*keys, text.alias("line"))


def polygons(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """A closed polygon a group of points in order."""
    corners = F.transform(F.array_sort(F.collect_list(F.struct(order, "x", "y", "z"))), lambda p: F.format_string("<%.6f,%.6f,%.6f>", p["x"], p["y"], p["z"]))
    rows = points.groupBy(*by).agg(corners.alias("c"))
    first = F.get("c", F.lit(0))
    return rows.select(*by, F.concat(F.format_string("polygon { %d, ", F.size("c") + 1), F.array_join("c", ", "), F.lit(", "), first, F.lit(" }")).alias("line"))


def camera(points: DataFrame, by: str, field_of_view: float = 100.0) -> DataFrame:
    """Camera, lights and middle of each neuron: it looks along z from far enough to see the widest axis."""
    spans = points.groupBy(by).agg(*[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    middle = {a: (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 for a in "xyz"}
    widest = F.greatest(*[F.col(f"{a}_max") - F.col(f"{a}_min") for a in "xyz"])
    back = -(widest * field_of_view / 100)
    head = F.concat(F.lit('#include "colors.inc"\nbackground { color Black }\ncamera { location '), vector(F.lit(0.0), F.lit(0.0), back), F.lit(" look_at <0,0,0> }\nlight_source { "), vector(F.lit(0.0), F.lit(0.0), back), F.lit(" color White }"))
    return spans.select(by, *[c.alias(f"{a}_middle") for a, c in middle.items()], head.alias("head"))


def scenes(lines: DataFrame, heads: DataFrame, by: str, order: str, suffix: str = ".pov") -> DataFrame:
    """``name, content``: a scene a neuron, its head and then its shapes in order."""
    body = lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.join(heads.select(by, "head"), by).select(F.concat(F.col(by).cast("string"), F.lit(suffix)).alias("name"), F.concat_ws("\n", "head", "body", F.lit("")).cast("binary").alias("content"))


# ------------------------------------------------------------------------- drawings
def projected(points: DataFrame, axes: str = "xy", which: tuple[str, ...] | None = None) -> DataFrame:
    """Points in two of their axes with their kind (of :func:`tree.point_classes`), all or some kinds."""
    from .tree import point_classes

    rows = point_classes(points)
    if which is not None:
        rows = rows.where(F.col("kind").isin(*which))
    return rows.select(KEY, "point_no", "kind", F.col(axes[0]).alias("u"), F.col(axes[1]).alias("v"))


def bright_voxels(voxels: DataFrame, by: list[str], quantile: float = 0.9) -> DataFrame:
    """Voxels above a quantile of their volume, with an opacity that is their share of the greatest value."""
    facts = voxels.groupBy(*by).agg(F.percentile("value", F.lit(quantile)).alias("_q"), F.max("value").alias("_m"))
    return voxels.join(F.broadcast(facts), by).where("value > _q").select(*by, *VOXEL, "value", (F.col("value") / F.col("_m")).alias("alpha"))


def levels(voxels: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """A slice's values as ``n`` equal levels from 0 (those outside the range: null)."""
    at = F.least(F.floor((F.col("value") - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")
    return voxels.withColumn("level", F.when(F.col("value").between(low, high), at))


def scale_levels(spark, low: float, high: float, n: int) -> DataFrame:
    """Edges and middles of a scale bar's levels."""
    i, step = F.col("id"), (high - low) / n
    return spark.range(n).select(i.cast("int").alias("level"), (low + i * step).alias("low"), (low + (i + 1) * step).alias("high"), (low + (i + 0.5) * step).alias("middle"))


def jet(spark, n: int) -> DataFrame:
    """``n`` colours from dark blue over cyan and yellow to dark red, as red, green and blue of 0..1."""
    x = F.when(F.lit(n) > 1, F.col("id") / (n - 1.0)).otherwise(F.lit(0.5))
    ramp = lambda middle: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * x - middle)))
    return spark.range(n).select(F.col("id").cast("int").alias("level"), ramp(3).alias("r"), ramp(2).alias("g"), ramp(1).alias("b"))


def jet_colour(share: Column) -> list[Column]:
    """Red, green and blue (0..1) of a share from 0 (dark blue) over cyan and yellow to 1 (dark red)."""
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * share - middle))) for middle in (3, 2, 1)]


def bars(values: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Edges and middles of the ``n`` levels of each group's scale bar, from its least to its greatest value."""
    span = values.groupBy(*by).agg(F.min(value).cast("double").alias("_l"), F.max(value).cast("double").alias("_h"))
    rows = span.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    edge = lambda shift: F.col("_l") + (F.col("level") + shift) * (F.col("_h") - F.col("_l")) / n
    return rows.select(*by, "level", edge(0).alias("low"), edge(1).alias("high"), edge(0.5).alias("middle"))


#: Turns (degrees about x, y, z) that bring a named side to the front.
VIEWS = {"front": (0, 0, 0), "left": (0, 90, 0), "right": (0, -90, 0), "back": (0, 180, 0), "ventral": (90, 0, 0), "dorsal": (-90, 0, 0)}


def viewed(points: DataFrame, side: str) -> DataFrame:
    from .geometry import rotation, transform_points

    return transform_points(points, rotation(*VIEWS[side], degrees=True))


# ---------------------------------------------------------------------- clusterings
def dendrogram(merges, n: int):
    """Pre-order walk of a clustering: ``(place, node, depth, height, first leaf, leaves)`` of every node; leaves are below ``n``."""
    out, stack, at = [], [(2 * n - 2, 0)], 0
    count = {i: 1 for i in range(n)} | {n + i: int(m[3]) for i, m in enumerate(merges)}
    leaf = 0
    while stack:
        node, depth = stack.pop()
        out.append((at, node, depth, 0.0 if node < n else float(merges[node - n][2]), leaf, count[node]))
        at += 1
        if node < n:
            leaf += 1
        else:
            left, right = (int(x) for x in merges[node - n][:2])
            stack += [(right, depth + 1), (left, depth + 1)]
    return out


def merged_labels(merges, labels: list):
    """Label of every node: that of its leaves where all are alike, else None."""
    found = list(labels)
    for left, right, *_ in merges:
        a, b = found[int(left)], found[int(right)]
        found.append(a if a == b else None)
    return found


def digests(dots: DataFrame, number: str = "dot_id") -> DataFrame:
    """MD5 of each cloud's places to six decimals, and its number of dots; dots without all coordinates add no text.

    Decimals are those of the exact binary values, ties to even, as C's ``printf`` gives
    them: ``format_string`` rounds the shortest decimal form half up.
    """

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: ";".join("%.6f,%.6f,%.6f" % tuple(p) for p in v.reshape(-1, 3).tolist()) if len(v) else None)

    whole = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull()
    places = F.transform(F.filter(F.array_sort(F.collect_list(F.struct(number, "x", "y", "z"))), whole), lambda p: F.array(*[p[a].cast("double") for a in "xyz"]))
    rows = dots.groupBy(KEY).agg(F.flatten(places).alias("places"), F.count("*").alias("n"))
    return rows.select(KEY, F.md5(text("places")).alias("digest"), "n")
