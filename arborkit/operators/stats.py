"""Aggregations, information theory and tests over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plogp(p: str) -> Column:
    return F.when(F.col(p) > 0, F.col(p) * F.log(p))


def entropies(pairs: DataFrame, bins: int = 99) -> DataFrame:
    """``ha, hb, hab`` of paired values ``(pair, a, b)`` binned over their shared range.

    Bins are right-closed and pairs at the shared minimum are left out; natural
    logarithms.  One grouping-sets aggregation gives the joint and both margins.
    """
    low, high = F.least(F.min("a"), F.min("b")), F.greatest(F.max("a"), F.max("b"))
    spans = pairs.groupBy("pair").agg(low.alias("low"), high.alias("high"))
    cut = lambda c: F.ceil((F.col(c) - F.col("low")) / ((F.col("high") - F.col("low")) / bins)).cast("int")
    binned = pairs.join(spans, "pair").where((F.col("a") > F.col("low")) & (F.col("b") > F.col("low"))).select("pair", cut("a").alias("ba"), cut("b").alias("bb"))
    sets = [["pair", "ba", "bb"], ["pair", "ba"], ["pair", "bb"]]
    counts = binned.groupingSets([[F.col(c) for c in s] for s in sets], "pair", "ba", "bb").agg((F.grouping("bb") * 2 + F.grouping("ba")).alias("g"), F.count("*").alias("n"))
    total = F.sum(F.when(F.col("g") == 0, F.col("n"))).over(Window.partitionBy("pair"))
    terms = counts.withColumn("p", F.col("n") / total).withColumn("t", -F.col("p") * F.log("p"))
    return terms.groupBy("pair").agg(*[F.sum(F.when(F.col("g") == g, F.col("t"))).alias(n) for g, n in ((2, "ha"), (1, "hb"), (0, "hab"))])


def mutual_information(h: DataFrame) -> DataFrame:
    nmi = F.try_divide(F.col("ha") + F.col("hb"), F.col("hab"))
    return h.withColumns({"mi": F.col("ha") + F.col("hb") - F.col("hab"), "nmi": nmi, "mi_distance": F.try_divide(F.lit(2.0), nmi) - 1})


def pooled_t(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Two-sample t with pooled variance of boolean ``group`` (true against false)."""
    x, y = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    m = df.groupBy(*by).agg(F.count(x).alias("n1"), F.count(y).alias("n2"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), F.var_samp(x).alias("v1"), F.var_samp(y).alias("v2"))
    m = m.where("n1 > 1 and n2 > 1")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    return m.select(*by, "n1", "n2", t.alias("t"))


#: Quantiles of a null distribution that are kept.
EXTREMES = (0.0, 0.001, 0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99, 0.999, 1.0)


def permuted_t(df: DataFrame, by: list[str], subject: str, value: str, permutations: int, seed: int) -> DataFrame:
    """t maps under random relabellings: in each, half of the subjects (those first by a seeded digest) are one group."""
    subjects = df.select(subject).distinct()
    half = subjects.agg(F.floor(F.count("*") / 2).alias("_half"))
    digest = F.md5(F.concat(F.col(subject).cast("string"), F.lit(":"), F.col("perm").cast("string"), F.lit(f":{seed}")))
    labels = subjects.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    place = F.row_number().over(Window.partitionBy("perm").orderBy(digest, subject))
    labels = labels.crossJoin(F.broadcast(half)).withColumn("one", place <= F.col("_half")).drop("_half")
    return pooled_t(df.join(labels, subject), ["perm", *by], "one", value)


def permutation_extremes(df: DataFrame, by: list[str], subject: str, value: str, permutations: int, seed: int) -> DataFrame:
    """Eleven quantiles (:data:`EXTREMES`) of the t map under each random relabelling of subjects."""
    maps = permuted_t(df, by, subject, value, permutations, seed)
    return maps.groupBy("perm").agg(F.percentile("t", F.array(*map(F.lit, EXTREMES))).alias("quantiles"))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width bins; the last one holds its upper edge."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(value).between(low, high)).select(*by, at.alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("count"))
    return rows.withColumn("density", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def cumulative(hist: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cdf", F.sum("density").over(w))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact linear-interpolation (type 7) quantiles of groups of any size.

    Distinct values are counted, range-partitioned by group and value, and each
    partition starts where those before it end; no task holds a group's values.
    """
    from arborkit.sources.files import scratch

    path = scratch(df.sparkSession, "quantiles")
    keys = [F.col(c) for c in by]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counts.repartitionByRange(*keys, F.col("_v")).sortWithinPartitions(*keys, "_v").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    starts = rows.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
    before, whole = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    starts = starts.select(*by, "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"), F.sum("_m").over(whole).alias("_all"))
    own = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(starts, [*by, "_part"]).withColumn("_first", F.col("_start") + F.col("_own"))
    held = lambda rank: F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n")), F.col("_v")))
    out, place = [], {}
    for i, q in enumerate(at):
        spot = (F.col("_all") - 1) * q
        out += [held(F.floor(spot)).alias(f"_lo{i}"), held(F.ceil(spot)).alias(f"_hi{i}")]
        place[q] = (F.col("_all") - 1) * q - F.floor((F.col("_all") - 1) * q)
    found = placed.groupBy(*by, "_all").agg(*out)
    named = [(F.col(f"_lo{i}") + place[q] * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{round(q * 100)}") for i, q in enumerate(at)]
    return found.select(*by, *named)


def first_n(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
