"""Tree operators on point tables ``(neuron_id, point_no, parent)``; roots have parent -1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborkit.sources.files import scratch

KEY = "neuron_id"


def edges(points: DataFrame) -> DataFrame:
    """Parent-to-child edges; roots give none."""
    return points.where("parent <> -1").select(KEY, F.col("parent").alias("src"), F.col("point_no").alias("dst"))


def double_edges(single: DataFrame) -> DataFrame:
    """Each edge in both directions, once.

    A neuron's edges are sorted, which spills, where points made from its rows lie
    already; a hash table of all edges would hold what a task has.
    """
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    edge = F.struct("src", "dst")
    rows = single.select(KEY, both.alias("e")).select(KEY, "e.src", "e.dst")
    before = F.lag(edge).over(Window.partitionBy(KEY).orderBy("src", "dst"))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != edge)).drop("_before")


def single_edges(double: DataFrame) -> DataFrame:
    """Undirected edges once, smaller end first."""
    return double.select(KEY, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def point_classes(points: DataFrame) -> DataFrame:
    """Adds ``n_children`` and ``kind``: root, branch (over one child), end or slab."""
    children = points.where("parent <> -1").groupBy(KEY, F.col("parent").alias("point_no")).agg(F.count("*").alias("n_children"))
    joined = points.join(children, [KEY, "point_no"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    kind = F.when(F.col("parent") == -1, "root").when(F.col("n_children") > 1, "branch").when(F.col("n_children") == 0, "end").otherwise("slab")
    return joined.withColumn("kind", kind)


def tree_counts(points: DataFrame) -> DataFrame:
    """Vertices, edges and trees (vertices minus edges) of each neuron."""
    return points.groupBy(KEY).agg(F.count("*").alias("n_points"), F.count_if(F.col("parent") != -1).alias("n_edges")).withColumn("n_trees", F.col("n_points") - F.col("n_edges"))


def trees_in_edges(double: DataFrame) -> DataFrame:
    """Trees of each neuron's double edge list: vertices minus half the edges."""
    # vertices are counted in order, as the edges are sorted
    before = F.lag("src").over(Window.partitionBy(KEY).orderBy("src", "dst"))
    fresh = F.col("src").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("src")))
    ends = double.withColumn("before", before).groupBy(KEY).agg(F.count_if(fresh).alias("v"), F.count("*").alias("e"))
    return ends.select(KEY, (F.col("v") - F.col("e") / 2).cast("long").alias("n_trees"))


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared checkpoint folder (a local one where none is set) and read back."""
    spark = df.sparkSession
    path = scratch(spark, "tree")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _drop(df: DataFrame, path: str) -> None:
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sums_to_root(points: DataFrame) -> DataFrame:
    """``value`` of ``(neuron_id, point_no, parent, value)`` summed from each point up to its root.

    Pointer doubling: each round adds the sum that the ancestor reached holds and
    doubles the reach, so a path of n points takes log2(n) joins.  A round writes
    only the points that are still under way; those that have reached their root
    stay in the table of the round in which they did.  Points that no root is above
    (a missing parent, a cycle) give none.
    """
    now, path = _written(points.select(KEY, "point_no", F.col("parent").alias("above"), "value"))
    rounds = now.count().bit_length() + 1  # a point still under way after these is on or below a cycle
    done = now.where("above = -1")
    while rounds and now.where("above <> -1").limit(1).count():
        reached = done.unionByName(now.where("above <> -1"))
        up = reached.select(KEY, F.col("point_no").alias("above"), F.col("above").alias("next"), F.col("value").alias("more"))
        moved = now.where("above <> -1").join(up, [KEY, "above"]).select(KEY, "point_no", F.col("next").alias("above"), (F.col("value") + F.col("more")).alias("value"))
        now, path = _written(moved)
        done, rounds = done.unionByName(now.where("above = -1")), rounds - 1
    return done.select(KEY, "point_no", "value")


def depths(points: DataFrame) -> DataFrame:
    """Edges between each point and its root."""
    return _sums_to_root(points.withColumn("value", F.lit(1))).select(KEY, "point_no", (F.col("value") - 1).alias("depth"))


def reroot(points: DataFrame, new_roots: DataFrame) -> DataFrame:
    """Make ``new_roots(neuron_id, point_no)`` the roots of their trees.

    Only edges on the path from the old root to the new one turn round.
    """
    up = path_to_root(points, new_roots)
    below = up.select(KEY, "start", (F.col("step") + 1).alias("step"), F.col("point_no").alias("was"))
    path = up.join(below, [KEY, "start", "step"], "left").select(KEY, "point_no", F.coalesce("was", F.lit(-1)).alias("turned"))
    return points.join(path, [KEY, "point_no"], "left").withColumn("parent", F.coalesce("turned", "parent")).drop("turned")


def path_to_root(points: DataFrame, starts: DataFrame) -> DataFrame:
    """Points from ``starts(neuron_id, point_no)`` up to the root with ``step``.

    Pointer doubling: each round moves the path so far up by its own length.
    """
    own = points.join(starts.select(KEY).distinct(), KEY, "left_semi")
    jump, jump_path = _written(own.where("parent <> -1").select(KEY, "point_no", F.col("parent").alias("above")).join(own.select(KEY, F.col("point_no").alias("above")), [KEY, "above"], "left_semi").select(KEY, "point_no", "above"))
    first = starts.select(KEY, "point_no").join(points.select(KEY, "point_no"), [KEY, "point_no"])
    now, path = _written(first.select(KEY, F.col("point_no").alias("start"), F.lit(0).alias("step"), "point_no"))
    reach, most = 1, jump.count()
    while True:
        moved = now.join(jump, [KEY, "point_no"]).select(KEY, "start", (F.col("step") + reach).alias("step"), F.col("above").alias("point_no"))
        new, new_path = _written(moved)
        if not new.limit(1).count():
            _drop(new, new_path)
            _drop(jump, jump_path)
            return now
        if reach > most:
            raise ValueError("a path to the root meets a cycle")
        after, after_path = _written(now.unionByName(new))
        far = jump.select(KEY, F.col("point_no").alias("above"), F.col("above").alias("next"))
        further, further_path = _written(jump.join(far, [KEY, "above"]).select(KEY, "point_no", F.col("next").alias("above")))
        for df, at in ((now, path), (new, new_path), (jump, jump_path)):
            _drop(df, at)
        now, path, jump, jump_path, reach = after, after_path, further, further_path, 2 * reach


def branch_orders(points: DataFrame) -> DataFrame:
    """Branch order: branch points between each point and the root."""
    own = point_classes(points).select(KEY, "point_no", "parent", (F.col("n_children") > 1).cast("int").alias("value"))
    before = own.select(KEY, "point_no", F.col("value").alias("own"))
    return _sums_to_root(own).join(before, [KEY, "point_no"]).select(KEY, "point_no", (F.col("value") - F.col("own")).alias("branch_order"))
