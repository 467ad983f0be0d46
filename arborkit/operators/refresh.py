"""Derived tables that are brought up to date: only what is new or changed is computed again.

A table's versions are folders ``version-<number>`` under one path; a version counts
once Spark has marked its write as done, so a run that breaks off leaves the one
before in place, and readers always see a whole version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay when a new one is written.
KEPT = 2


def digests(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, digest`` of each key's rows, whatever their order: their number and two sums of 64-bit hashes."""
    hashes = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    parts: list[Column] = [F.count("*"), F.bit_xor(hashes[0]), F.sum(F.shiftrightunsigned(hashes[1], 16))]
    return rows.groupBy(key).agg(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])).alias("digest"))


def _versions(spark: SparkSession, path: str) -> tuple[object, object, list[tuple[int, object]]]:
    """File system, folder and the numbers and places of whole versions, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    if system.exists(folder):
        for status in system.listStatus(folder):
            place = status.getPath()
            name = place.getName()
            if name.startswith("version-") and system.exists(jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
                found.append((int(name.removeprefix("version-")), place))
    return system, folder, sorted(found, key=lambda x: x[0])


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table, or None."""
    versions = _versions(spark, path)[2]
    return spark.read.parquet(versions[-1][1].toString()) if versions else None


def refreshed(spark: SparkSession, path: str, items: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """The table ``key, digest, ...`` at ``path`` for ``items(key, digest)``, with a new version where that differs.

    ``compute`` gets the keys that are not known with their digest and returns their
    rows.  Rows of other keys stay as they are; those of keys that are gone are left
    out.  Keys are unique in ``items``; null keys are left out.
    """
    system, _, versions = _versions(spark, path)
    items = items.where(F.col(key).isNotNull()).select(key, "digest")
    known = spark.read.parquet(versions[-1][1].toString()) if versions else None
    stale = items if known is None else items.join(known.select(key, "digest"), [key, "digest"], "left_anti")
    gone = known is not None and bool(known.join(items, key, "left_anti").take(1))
    if known is not None and not gone and not stale.take(1):
        return known
    fresh = compute(stale.select(key)).join(stale, key)
    fresh = fresh.select(key, "digest", *[c for c in fresh.columns if c not in (key, "digest")])
    if known is not None:
        kept = known.join(items, [key, "digest"], "left_semi")
        fresh = kept.unionByName(fresh.select(*known.columns))
    number = versions[-1][0] + 1 if versions else 1
    fresh.write.mode("overwrite").parquet(f"{path}/version-{number:06}")
    for _, place in versions[: len(versions) + 1 - KEPT]:
        system.delete(place, True)
    return spark.read.parquet(f"{path}/version-{number:06}")


def refreshed_backgrounds(spark: SparkSession, path: str, histograms: DataFrame, by: str, truncate: float = 1.0) -> DataFrame:
    """Background fits ``by, digest, mu, sigma, threshold`` of histograms ``(by, bin, hi, count)``; only changed ones are fitted."""
    from .images import background

    def fit(keys: DataFrame) -> DataFrame:
        return background(histograms.join(keys, by, "left_semi"), by, truncate)

    return refreshed(spark, path, digests(histograms, by, ["bin", "hi", "count"]), fit, by)
