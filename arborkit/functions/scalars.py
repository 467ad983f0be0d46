"""Scalar functions as column expressions: normal distribution, vectors, colours, matching by name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of the error function's Taylor series, exact to rounding for |x| < 3.
_TERMS = 60


def erf(x: Column) -> Column:
    """Error function to about 1e-12 without leaving the JVM.

    Near zero its Maclaurin series, further out the continued fraction of its
    complement (48 levels), both evaluated as one higher-order expression.
    """
    near = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        F.struct(x.cast("double").alias("term"), x.cast("double").alias("total")),
        lambda s, n: F.struct((-s["term"] * x * x / n).alias("term"), (s["total"] - s["term"] * x * x / n / (2 * n + 1)).alias("total")),
        lambda s: s["total"] * (2 / math.sqrt(math.pi)),
    )
    a = F.abs(x)
    tail = F.aggregate(F.sequence(F.lit(48), F.lit(1), F.lit(-1)), a.cast("double"), lambda s, n: a + n / 2.0 / s)
    far = F.signum(x) * (1 - F.exp(-x * x) / math.sqrt(math.pi) / tail)
    return F.when(a < 2.5, near).when(a < 6, far).otherwise(F.signum(x))


def cumnorm(x: Column, mu: float | Column = 0.0, sigma: float | Column = 1.0) -> Column:
    """Normal cumulative distribution."""
    return 0.5 * (1 + erf((x - mu) / (sigma * math.sqrt(2))))


def downsampling_sigma(by: Column, source: float = 0.5, target: float = 0.5, pixel: float = 1.0) -> Column:
    """Blur that brings a source blur to the target's at ``by`` times the pixel; NaN where none is needed."""
    return F.sqrt(F.pow(by * target, F.lit(2)) - source**2) * pixel


def sin_theta(cosine: Column) -> Column:
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.sqrt(1 - held * held)


#: Named colours as red, green and blue of 0..31, in the order of their numbers from 1.
COLOURS = {
    "red": (31, 0, 0), "green": (0, 31, 0), "blue": (0, 0, 31), "purple": (31, 0, 31), "cyan": (0, 31, 31), "yellow": (31, 31, 0), "peach": (31, 15, 15), "eight": (15, 31, 15),
    "nine": (15, 15, 31), "ten": (31, 15, 0), "eleven": (31, 0, 15), "twelve": (15, 0, 31), "thirteen": (15, 31, 0), "fourteen": (0, 15, 31), "white": (31, 31, 31),
}


def colour(name_or_number: Column) -> Column:
    """``array(r, g, b)`` of a colour's name, or of its number from 1 (below 1: white); else null."""
    by_name = F.create_map(*[x for name, rgb in COLOURS.items() for x in (F.lit(name), F.array(*map(F.lit, rgb)))])
    names = F.array(*map(F.lit, COLOURS))
    number = name_or_number.try_cast("int")
    name = F.when(number.isNull(), name_or_number).when(number < 1, "white").otherwise(F.get(names, number - 1))
    return F.try_element_at(by_name, name)


def image_id(name: Column) -> Column:
    """Image id of a file name: what stands between underscores, upper-cased, a final image number cut."""
    x = F.regexp_replace(name, r"^[^_]*_([^_]*)_[^_]*$", "$1")
    x = F.regexp_extract(x, r"([^/]*)/?$", 1)
    x = F.regexp_replace(x, r"^([^_]*?)[._].*$", "$1")
    x = F.upper(F.regexp_replace(x, r"(?i)^([A-Z]{2,3}[1-9][0-9]{0,2}[RLTB]([1-4]|LH)).*$", "$1"))
    return F.regexp_replace(x, r"^(.*)0[1-3]$", "$1")


def brain_id(name: Column) -> Column:
    """Brain of an image id: without image number, a final LH or what follows a hyphen."""
    x = F.regexp_replace(image_id(name), r"(?i)^([A-Z]{2,3}[1-9][0-9]{0,2}[RLTB])([1-4]|LH)?.*$", "$1")
    return F.regexp_replace(F.regexp_replace(x, r"^(.*)LH$", "$1"), r"^(.*?)-.*$", "$1")


def matching(df: DataFrame, column: str, pattern: str, keep: bool = True) -> DataFrame:
    """Rows that match a pattern (or do not); all rows where none matches."""
    hit = F.col(column).rlike(pattern)
    found = df.agg(F.max(hit).alias("_any"))
    chosen = hit if keep else ~hit
    return df.crossJoin(F.broadcast(found)).where(~F.coalesce(F.col("_any"), F.lit(False)) | chosen).drop("_any")


def positions_in(x: DataFrame, y: DataFrame, column: str) -> DataFrame:
    """Rows of ``x`` whose ``column`` is found in ``y``."""
    return x.join(y.select(column).distinct(), column, "left_semi")


def of_types(df: DataFrame, types: list[str], column: str = "cell_type") -> DataFrame:
    """Rows whose type is among ``types``, whatever the case."""
    return df.where(F.upper(column).isin([t.upper() for t in types]))


def tidy(df: DataFrame, keep_text: float = 1.0, longest: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    r"""Column types inferred from what a table of strings holds.

    All null: boolean.  Named like a date: date, ``\N`` cut.  One character, T or F
    only: boolean.  Other strings stay (few and short distinct values are what
    other systems call factors, and dictionary encoding keeps them small).
    """
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in keep]
    if not texts:
        return df
    q = lambda c: F.col(f"`{c}`")
    facts = df.agg(*[F.struct(F.count(q(c)).alias("n"), F.max(F.length(q(c))).alias("len"), F.min(q(c).isin("T", "F")).alias("tf")).alias(f"f{i}") for i, c in enumerate(texts)]).first()
    new = {}
    for i, c in enumerate(texts):
        n, size, truth = facts[i]
        if n == 0:
            new[c] = F.lit(None).cast("boolean")
        elif "date" in c.lower():
            new[c] = F.try_to_timestamp(F.nullif(F.regexp_replace(q(c), r"\\N", ""), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
        elif size == 1 and truth:
            new[c] = q(c) == "T"
    return df.withColumns(new) if new else df
