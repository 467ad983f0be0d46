"""Neuro-shaped tables derived from the generic test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point table of branching trees (a binary heap per order); root parent -1."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", number.alias("point_no"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return rows.select(
        F.col("l_orderkey").alias("neuron_id"),
        "point_no",
        F.lit(2).alias("label"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
        (2 * F.col("l_tax")).alias("w"),
        F.when(F.col("point_no") == 1, -1).otherwise(F.floor(F.col("point_no") / 2)).cast("int").alias("parent"),
        F.col("l_returnflag").alias("region"),
    )


def neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("neuron_id"), F.col("o_orderpriority").alias("cell_type"), F.col("o_custkey").alias("brain"))


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 points of each embedding: three consecutive components each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    dots = rows.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("dot_id"))
    at = [F.get("embedding", F.col("dot_id") * 3 + i).cast("double").alias(c) for i, c in enumerate("xyz")]
    return dots.select(F.col("vec_id").alias("neuron_id"), "label", "dot_id", *at)


POINTS_SQL = f"""
points AS (
  SELECT neuron_id, point_no, 2 AS label, x, y, z, w, region,
         CASE WHEN point_no = 1 THEN -1 ELSE point_no // 2 END AS parent
  FROM (SELECT l_orderkey AS neuron_id, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z,
               2 * l_tax AS w, l_returnflag AS region,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS INTEGER) AS point_no
        FROM lineitem)),
neurons AS (SELECT o_orderkey AS neuron_id, o_orderpriority AS cell_type, o_custkey AS brain FROM orders),
seglets AS (
  SELECT c.neuron_id, c.point_no, c.parent, p.x AS x0, p.y AS y0, p.z AS z0, c.x AS x1, c.y AS y1, c.z AS z1,
         sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2) AS len
  FROM points c JOIN points p ON c.neuron_id = p.neuron_id AND c.parent = p.point_no)
"""


def arbors(spark: SparkSession, sf_dir: str, forest: bool = True) -> DataFrame:
    """Point table of deep trees: each supplier's lines, chained, with a side branch every 13th point.

    In a ``forest`` every 401st point begins a tree of its own.
    """
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", *_ORDER))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", number.alias("point_no"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    n = F.col("point_no")
    return rows.select(
        F.col("l_suppkey").alias("neuron_id"),
        "point_no",
        F.lit(2).alias("label"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
        (2 * F.col("l_tax")).alias("w"),
        F.when((n == 1) | (F.lit(forest) & (n % 401 == 0)), -1).when(n % 13 == 0, F.floor(n / 2)).otherwise(n - 1).cast("int").alias("parent"),
        F.col("l_returnflag").alias("region"),
    )


ARBORS_SQL = f"""
arbors AS MATERIALIZED (
  SELECT neuron_id, point_no, 2 AS label, x, y, z, w, region,
         CASE WHEN point_no = 1 OR point_no % 401 = 0 THEN -1 WHEN point_no % 13 = 0 THEN point_no // 2 ELSE point_no - 1 END AS parent
  FROM (SELECT l_suppkey AS neuron_id, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z,
               2 * l_tax AS w, l_returnflag AS region,
               CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {', '.join(_ORDER)}) AS INTEGER) AS point_no
        FROM lineitem))
"""

#: One tree a neuron.
TREES_SQL = ARBORS_SQL.replace("arbors AS", "trees AS").replace(" OR point_no % 401 = 0", "")


#: A grid over each neuron's box: three to five points an axis, more for higher numbers.
BOXES_SQL = ARBORS_SQL + """, box AS (SELECT neuron_id, min(x) AS low_x, max(x) AS high_x, min(y) AS low_y, max(y) AS high_y, min(z) AS low_z, max(z) AS high_z,
  (3 + neuron_id % 3)::INTEGER AS n_x, 4 AS n_y, (2 + count(*) % 2)::INTEGER AS n_z FROM arbors GROUP BY neuron_id)"""


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [f(a).alias(f"{t}_{a}") for a in "xyz" for t, f in (("low", F.min), ("high", F.max))]
    rows = arbors(spark, sf_dir).groupBy("neuron_id").agg(*ends, F.count("*").alias("n"))
    return rows.select("neuron_id", *[f"{t}_{a}" for a in "xyz" for t in ("low", "high")], (3 + F.col("neuron_id") % 3).cast("int").alias("n_x"), F.lit(4).alias("n_y"), (2 + F.col("n") % 2).cast("int").alias("n_z"))
