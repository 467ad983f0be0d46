"""Cross-site line dedup from distinct-site spread.  DataFrame functions only.

A line is a text cut at ``\\n``, without surrounding spaces; blank lines are
never judged.  A line whose distinct sites number ``min_sites`` or more is
boilerplate and goes from every document.

Per line hash, a HyperLogLog sketch of its sites is built on the map side and
merged by aggregation.  Estimates outside ``near`` of the threshold decide;
lines within it get exact distinct-site counts (a two-step aggregation over the
near lines only).  Boilerplate hashes then meet the lines again in an
equi-join, which adaptive execution may split for a line that is everywhere,
and each document drops its lines by position.

Line identity is a pair of independent hashes (64 and 32 bits).  Null site:
counts as no site.  Null text stays null, with 0 lines; empty text is one blank
line.  ``doc_id`` may be null or repeated: rows are told apart by id and text.
A text of one line, of blank lines only or of millions of lines is judged like
any other.  Extra columns pass through whatever their names, but for older ones
named ``n_lines``, ``n_removed`` or ``kept_text``, which the outputs replace.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, unboxed

#: log2 of sketch slots: a relative standard error of 1.6 %.
SKETCH_BITS = 12
#: Estimates within this factor of the threshold are counted exactly.
NEAR = 1.5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def boilerplate_lines(lines: DataFrame, min_sites: int, near: float = NEAR) -> DataFrame:
    """``h1, h2`` of lines on ``min_sites`` sites or more; ``lines(h1, h2, site)``."""
    lines = lines.where("site is not null")
    spread = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"))
    # a line on m sites has m rows at least, so fewer rows settle it
    spread = spread.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialize(spread.where(F.col("sites") >= min_sites / near), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * near).select("h1", "h2")
    close = spread.where(F.col("sites") <= min_sites * near).select("h1", "h2")
    exact = lines.join(close, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))


def judge_lines(docs: DataFrame, min_sites: int = 15, site: str = "source") -> DataFrame:
    """All columns of ``docs`` with ``n_lines, n_removed, kept_text``."""
    read = tuple(dict.fromkeys(("doc_id", "text", site)))
    keyed = boxed(docs, *read).withColumn("text", F.col("text").cast("string"))
    keyed = keyed.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "__text": F.xxhash64("text")})
    placed = keyed.select("__key", "__text", F.col(f"`{site}`").cast("string").alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    placed = placed.withColumn("line", F.trim("line")).where("line <> ''").select("__key", "__text", "site", "pos", *_key(F.col("line")))
    found = boilerplate_lines(placed.select("h1", "h2", "site"), min_sites)
    gone = placed.select("__key", "__text", "pos", "h1", "h2").join(found, ["h1", "h2"], "left_semi")
    gone = gone.groupBy("__key", "__text").agg(F.collect_set("pos").alias("__gone"))
    joined = keyed.join(gone, ["__key", "__text"], "left").withColumn("__lines", _lines(F.col("text")))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines"))
    # positions that stay, by hashed set difference, then their lines in order
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    joined = joined.withColumn("n_lines", size.cast("long")).withColumn("__stay", F.when(F.col("__gone").isNotNull(), stay))
    text = F.when(F.col("__stay").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__stay", lambda p: F.get("__lines", p)), "\n"))
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    joined = joined.withColumns({"n_removed": removed.cast("long"), "kept_text": text})
    added = ("n_lines", "n_removed", "kept_text")
    own = {c: F.col(c) for c in added if c in docs.columns}
    return unboxed(joined, docs.columns, read, *[c for c in added if c not in own], **own)


def remove_boilerplate_lines(docs: DataFrame, min_sites: int = 15, site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``."""
    read = tuple(dict.fromkeys(("doc_id", "text", site)))
    return unboxed(judge_lines(boxed(docs, *read), min_sites, site), docs.columns, read, text=F.col("kept_text"))
