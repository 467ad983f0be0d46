"""Segments of trees: unbranched runs between roots, branch points and ends.

A segment table is long: ``neuron_id, tree_no, seg_no, seg_order, pos, point_no``,
position 0 being the segment's head.  Each neuron is walked once in one Arrow
call, so trees of any depth take one shuffle by neuron.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborkit.sources.files import lists

from .tree import KEY, point_classes

ARRAYS = "array<int>"
SEGMENT = ["tree_no", "seg_no"]


def children_of(points: list[int], parents: list[int]) -> tuple[list[int], dict[int, list[int]]]:
    """Roots and every point's children, both in ascending order."""
    below: dict[int, list[int]] = {}
    known = set(points)
    roots = []
    for point, parent in sorted(zip(points, parents)):
        if parent in known and parent != point:
            below.setdefault(parent, []).append(point)
        else:
            roots.append(point)
    return roots, below


def walk_tree(root: int, below: dict[int, list[int]]) -> list[tuple[int, list[int]]]:
    """Order and points of each segment, depth first, smaller children first."""
    found = []
    stack = [(root, child, 1) for child in reversed(below.get(root, []))]
    while stack:
        head, point, order = stack.pop()
        run = [head, point]
        while len(nxt := below.get(point, [])) == 1:
            point = nxt[0]
            run.append(point)
        found.append((order, run))
        stack += [(point, child, order + 1) for child in reversed(nxt)]
    return found or [(1, [root])]


def tree_sizes(roots: list[int], below: dict[int, list[int]]) -> list[int]:
    sizes = []
    for root in roots:
        n, stack = 0, [root]
        while stack:
            n += 1
            stack += below.get(stack.pop(), [])
        sizes.append(n)
    return sizes


def per_neuron(df: DataFrame, columns: list[str], walk: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``walk`` of each neuron's columns as lists; ``schema`` names what it gives beside the neuron."""
    kind = df.schema[KEY].dataType.simpleString()
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    added = {x.split()[0]: types[x.split()[1]] for x in schema.split(", ")}

    def run(t: pa.Table) -> pa.Table:
        made = walk(lists(t, columns))
        n = len(made[next(iter(added))])
        return pa.table({KEY: pa.array([t.column(KEY)[0].as_py()] * n, t.schema.field(KEY).type), **{c: pa.array(made[c], kind) for c, kind in added.items()}})

    return df.select(KEY, *columns).groupBy(KEY).applyInArrow(run, f"{KEY} {kind}, {schema}")


def segment_list(points: DataFrame) -> DataFrame:
    """Segments of every tree; tree 1 is the largest (ties: the smallest root), the rest by root.

    Of a tree's segments those nearer the root come first, depth first and smaller
    children first.  ``seg_order`` is 1 at the root and grows by one at each branch
    point.  A tree of one point is one segment of one point.
    """

    def walk(own: dict[str, list]) -> dict[str, list]:
        roots, below = children_of(own["point_no"], own["parent"])
        sizes = tree_sizes(roots, below)
        master = max(range(len(roots)), key=lambda i: (sizes[i], -roots[i])) if roots else 0
        out: dict[str, list] = {c: [] for c in ("tree_no", "seg_no", "seg_order", "pos", "point_no")}
        for number, at in enumerate([master, *[i for i in range(len(roots)) if i != master]][: len(roots)]):
            for seg, (order, run) in enumerate(walk_tree(roots[at], below)):
                n = len(run)
                for c, values in zip(out, ([number + 1] * n, [seg + 1] * n, [order] * n, range(n), run)):
                    out[c] += values
        return out

    return per_neuron(points, ["point_no", "parent"], walk, "tree_no int, seg_no int, seg_order int, pos int, point_no int")


def with_places(segments: DataFrame, points: DataFrame) -> DataFrame:
    return segments.join(points.select(KEY, "point_no", *"xyz"), [KEY, "point_no"])


def _along(*more: str) -> Window:
    return Window.partitionBy(KEY, *SEGMENT, *more).orderBy("pos")


def _step(w) -> Column:
    return F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in "xyz"), F.lit(0.0)))


def segment_lengths(segments: DataFrame, points: DataFrame) -> DataFrame:
    steps = with_places(segments, points).withColumn("step", _step(_along()))
    return steps.groupBy(KEY, *SEGMENT, "seg_order").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.count("*").alias("n_points"))


def neuron_summary(points: DataFrame, segments: DataFrame) -> DataFrame:
    """One row a neuron: start point of the master tree, counts, branch and end points."""
    kinds = point_classes(points).select(KEY, "point_no", "kind", "n_children")
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("point_no"))))
    lone = (F.col("kind") == "root") & (F.col("n_children") <= 1)
    marks = kinds.groupBy(KEY).agg(F.count("*").alias("n_points"), listed(F.col("kind") == "branch").alias("branch_points"), listed((F.col("kind") == "end") | lone).alias("end_points"))
    first = (F.col("tree_no") == 1) & (F.col("seg_no") == 1) & (F.col("pos") == 0)
    counts = segments.groupBy(KEY).agg(F.max(F.when(first, F.col("point_no"))).alias("start_point"), F.max("tree_no").alias("n_trees"), F.max(F.when(F.col("tree_no") == 1, F.col("seg_no"))).alias("n_segs"))
    return marks.join(counts, KEY)


def segment_edges(segments: DataFrame) -> DataFrame:
    """Consecutive points of each segment; single points give none."""
    after = F.lead("point_no").over(_along())
    return segments.select(KEY, F.col("point_no").alias("src"), after.alias("dst")).where("dst is not null")


def segment_ends(segments: DataFrame) -> DataFrame:
    """Head and tail of each segment: the tree with unbranched points left out."""
    ends = segments.groupBy(KEY, *SEGMENT).agg(F.min_by("point_no", "pos").alias("src"), F.max_by("point_no", "pos").alias("dst"), F.max("pos").alias("last"))
    return ends.where("last > 0").select(KEY, *SEGMENT, "src", "dst")


def adjacency(edges: DataFrame, undirected: bool = False) -> DataFrame:
    """Sparse 0/1 matrix ``row, col, value``; never dense."""
    rows = edges.select(KEY, F.col("src").alias("row"), F.col("dst").alias("col"))
    if undirected:
        rows = rows.unionByName(rows.select(KEY, F.col("col").alias("row"), F.col("row").alias("col")))
    return rows.distinct().withColumn("value", F.lit(1))


def reduced_adjacency(edges: DataFrame) -> DataFrame:
    """Undirected adjacency among points that do not have exactly two neighbours."""
    both = adjacency(edges, undirected=True)
    kept = both.groupBy(KEY, "row").agg(F.count("*").alias("n")).where("n <> 2").select(KEY, "row")
    return both.join(kept, [KEY, "row"], "left_semi").join(kept.withColumnRenamed("row", "col"), [KEY, "col"], "left_semi").select(KEY, "row", "col", "value")


def graph(points: DataFrame, edges: DataFrame, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices (``vertex`` numbered from 1 by label) and edges between vertices.

    Raises where a neuron has a label twice.  ``prune`` leaves out vertices without an edge.
    """
    if points.groupBy(KEY, "point_no").count().where("count > 1").limit(1).count():
        raise ValueError("a point label occurs twice")
    labels = points.select(KEY, F.col("point_no").alias("label"))
    if prune:
        used = edges.select(KEY, F.col("src").alias("label")).unionByName(edges.select(KEY, F.col("dst").alias("label"))).distinct()
        labels = labels.join(used, [KEY, "label"], "left_semi")
    vertices = labels.withColumn("vertex", F.row_number().over(Window.partitionBy(KEY).orderBy("label")))
    number = lambda end: vertices.select(KEY, F.col("label").alias(end), F.col("vertex").alias(f"{end}_vertex"))
    return vertices, edges.join(number("src"), [KEY, "src"]).join(number("dst"), [KEY, "dst"]).select(KEY, "src_vertex", "dst_vertex")


def sub_trees(edges: DataFrame) -> DataFrame:
    """``tree``, the smallest connected vertex, of every vertex of an edge list in any direction."""

    def walk(own: dict[str, list]) -> dict[str, list]:
        up = {v: v for v in own["src"] + own["dst"]}

        def find(v):
            while up[v] != v:
                up[v] = v = up[up[v]]
            return v

        for a, b in zip(own["src"], own["dst"]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        vertices = sorted(up)
        return {"point_no": vertices, "tree": [find(v) for v in vertices]}

    return per_neuron(edges, ["src", "dst"], walk, "point_no int, tree int")


def parents_from_segments(segments: DataFrame) -> DataFrame:
    """Each point's parent as the segments put it: the point before; heads of first segments are roots."""
    before = segments.withColumn("parent", F.lag("point_no").over(_along()))
    return before.groupBy(KEY, "point_no").agg(F.coalesce(F.max("parent"), F.lit(-1)).alias("parent"))


def neighbours(points: DataFrame) -> DataFrame:
    """Parent and children of every point, the parent first."""
    below = points.where("parent <> -1").groupBy(KEY, F.col("parent").alias("point_no")).agg(F.array_sort(F.collect_list(F.col("point_no"))).alias("below"))
    joined = points.select(KEY, "point_no", "parent").join(below, [KEY, "point_no"], "left")
    own = F.when(F.col("parent") == -1, F.array().cast(ARRAYS)).otherwise(F.array("parent").cast(ARRAYS))
    return joined.select(KEY, "point_no", F.concat(own, F.coalesce("below", F.array().cast(ARRAYS))).alias("neighbours"))


def path_between(points: DataFrame, ends: DataFrame) -> DataFrame:
    """Points on the way from ``ends(neuron_id, src, dst)``: ``step`` 0 at the source; none across trees."""
    joined = points.select(KEY, "point_no", "parent").join(ends.select(KEY, "src", "dst"), KEY)

    def walk(own: dict[str, list]) -> dict[str, list]:
        up = dict(zip(own["point_no"], own["parent"]))
        src, dst = own["src"][0], own["dst"][0]
        climb, place, at = [], {}, src
        while at in up:
            place[at] = len(climb)
            climb.append(at)
            at = up[at]
        down, at = [], dst
        while at in up and at not in place:
            down.append(at)
            at = up[at]
        way = climb[: place[at] + 1] + down[::-1] if at in place else []
        return {"step": list(range(len(way))), "point_no": way}

    return per_neuron(joined, ["point_no", "parent", "src", "dst"], walk, "step int, point_no int")


def sub_neuron(segments: DataFrame, path: DataFrame) -> DataFrame:
    """Segments both of whose ends, and with them all points, lie on a path."""
    ends = segment_ends(segments)
    on = path.select(KEY, F.col("point_no").alias("src")).distinct()
    kept = ends.join(on, [KEY, "src"], "left_semi").join(on.withColumnRenamed("src", "dst"), [KEY, "dst"], "left_semi")
    return segments.join(kept.select(KEY, *SEGMENT), [KEY, *SEGMENT], "left_semi")


def merge_paths(points: DataFrame, path: str) -> DataFrame:
    """Separate trees of one neuron, numbered by ``path``, as one table with new point numbers.

    Points are numbered on from path to path; ``sub_tree`` is the path's rank.
    """
    sizes = points.groupBy(KEY, path).agg(F.count("*").alias("n"))
    w = Window.partitionBy(KEY).orderBy(path)
    shift = sizes.select(KEY, path, F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"), F.row_number().over(w).alias("sub_tree"))
    number = F.row_number().over(Window.partitionBy(KEY, path).orderBy("point_no"))
    old = points.withColumn("place", number)
    above = old.select(KEY, path, F.col("point_no").alias("parent"), F.col("place").alias("above"))
    joined = old.join(shift, [KEY, path]).join(above, [KEY, path, "parent"], "left")
    parent = F.when(F.col("above").isNull(), F.lit(-1)).otherwise(F.col("above") + F.col("shift"))
    return joined.select(KEY, (F.col("place") + F.col("shift")).cast("int").alias("point_no"), parent.cast("int").alias("parent"), "sub_tree", *"xyz")


def partition(segments: DataFrame, key_points: DataFrame) -> DataFrame:
    """Segment types of tree 1 given ``key_points(neuron_id, lh_branch_point, mb_points)``.

    1: axon, the segments from the root to the horn's branch point; 2: the horn,
    the segments below that point; 3: collaterals, the segments that leave the
    axon from the heads of axon segments between the two body points (or from the
    further one) and all below them; -1: the rest.  A body point that no segment
    ends at gives no collaterals.
    """
    joined = segments.where("tree_no = 1").join(key_points.select(KEY, "lh_branch_point", "mb_points"), KEY)

    def walk(own: dict[str, list]) -> dict[str, list]:
        runs: dict[int, list[tuple[int, int]]] = {}
        order = dict(zip(own["seg_no"], own["seg_order"]))
        for seg, pos, point in zip(own["seg_no"], own["pos"], own["point_no"]):
            runs.setdefault(seg, []).append((pos, point))
        head = {s: min(r)[1] for s, r in runs.items()}
        tail = {max(r)[1]: s for s, r in runs.items()}
        leaving: dict[int, list[int]] = {}
        for s in sorted(head):
            leaving.setdefault(head[s], []).append(s)
        ends = {s: p for p, s in tail.items()}

        def below(s):
            stack, all_ = [s], []
            while stack:
                x = stack.pop()
                all_.append(x)
                stack += leaving.get(ends[x], [])
            return all_

        kinds = dict.fromkeys(head, -1)
        axon, at = [], own["lh_branch_point"][0]
        while at in tail:
            axon.append(tail[at])
            at = head[tail[at]]
        for s in leaving.get(own["lh_branch_point"][0], []):
            kinds.update(dict.fromkeys(below(s), 2))
        kinds.update(dict.fromkeys(axon, 1))
        body = sorted((p for p in own["mb_points"][0] or [] if p in tail), key=lambda p: order[tail[p]])
        if len(body) == 2:
            first, last = (order[tail[p]] for p in body)
            starts = {head[s] for s in axon if first < order[s] <= last} | {body[1]}
            for point in starts:
                for s in leaving.get(point, []):
                    if kinds[s] == -1:
                        kinds.update({x: 3 for x in below(s) if kinds[x] == -1})
        return {"seg_no": sorted(kinds), "kind": [kinds[s] for s in sorted(kinds)]}

    return per_neuron(joined, ["seg_no", "seg_order", "pos", "point_no", "lh_branch_point", "mb_points"], walk, "seg_no int, kind int")


# ------------------------------------------------------------------ along segments
def start_end_list(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Straight pieces along each segment: ``x0.. x1..`` and ``len``."""
    w = _along()
    rows = with_places(segments, points)
    rows = rows.select(KEY, *SEGMENT, "pos", *[F.col(a).alias(a + "0") for a in "xyz"], *[F.lead(a).over(w).alias(a + "1") for a in "xyz"]).where("x1 is not null")
    return rows.withColumn("len", F.sqrt(sum(((F.col(a + "1") - F.col(a + "0")) ** 2 for a in "xyz"), F.lit(0.0))))


def measured(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Points of segments with ``s``, their distance along the segment."""
    w = _along()
    rows = with_places(segments, points).withColumn("step", F.coalesce(_step(w), F.lit(0.0)))
    return rows.withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _led(rows: DataFrame) -> DataFrame:
    w = _along()
    return rows.select(KEY, *SEGMENT, "pos", "s", *"xyz", F.lead("s").over(w).alias("s1"), *[F.lead(a).over(w).alias(a + "1") for a in "xyz"])


def resample_segments(segments: DataFrame, points: DataFrame, step: float) -> DataFrame:
    """Every segment anew at ``step, 2 step, ..`` of its length, ends kept, as a new point table.

    Heads that an earlier segment ends at are not repeated.  Points are numbered
    segment by segment; each one's parent is the point before it on its segment.  A
    neuron's segments share one Arrow call, as when they are found.
    """
    kinds = {c: segments.schema[c].dataType.simpleString() for c in (KEY, *SEGMENT)}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in (*SEGMENT, "pos")])
        tree, seg, old = (t.column(c).to_numpy() for c in (*SEGMENT, "point_no"))
        xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1).astype(float)
        absent = np.stack([t.column(c).is_null().to_numpy() for c in "xyz"], axis=1)
        cuts = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (seg[1:] != seg[:-1]), True])
        heads, tails = cuts[:-1], cuts[1:] - 1
        run_of = np.repeat(np.arange(len(heads)), np.diff(cuts))
        # a piece that has no length, as an end is absent, adds none
        lengths = np.sqrt((np.diff(xyz, axis=0) ** 2).sum(axis=1))
        lengths[(absent[1:] | absent[:-1]).any(axis=1)] = 0.0
        s = np.concatenate([np.r_[0.0, np.cumsum(lengths[lo:hi])] for lo, hi in zip(heads, tails)])
        at = np.flatnonzero(run_of[1:] == run_of[:-1])
        with np.errstate(invalid="ignore"):
            first, last = np.floor(s[at] / step) + 1, np.ceil(s[at + 1] / step) - 1
            counts = np.maximum(np.nan_to_num(last - first + 1), 0).astype(np.int64)
        row = np.repeat(at, counts)
        spot = (np.repeat(first, counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * float(step)
        total = s[tails][run_of[row]]
        inside = (spot < total) | np.isnan(total)  # a place that meets the segment's end is the end
        row, spot = row[inside], spot[inside]
        share = ((spot - s[row]) / (s[row + 1] - s[row]))[:, None]
        # heads of first segments, what lies between, tails
        roots = heads[seg[heads] == 1]
        ends = np.unique(np.r_[roots, tails[tails > heads]])
        order = np.argsort(np.r_[row + 0.5, ends.astype(float)], kind="stable")
        along = np.r_[spot, s[ends]][order]
        places = np.concatenate([xyz[row] + share * (xyz[row + 1] - xyz[row]), xyz[ends]])[order]
        gone = np.concatenate([absent[row] | absent[row + 1], absent[ends]])[order]
        own = np.r_[run_of[row], run_of[ends]][order]
        number = np.arange(1, len(own) + 1)
        begins = np.r_[True, own[1:] != own[:-1]][: len(own)]
        # a later segment begins at the tail of the one that ends there
        above = {(tree[r], old[r]): n for r, n in zip(heads[own[begins]], number[begins]) if seg[r] == 1}
        for r, n in zip(own[begins], np.r_[number[begins][1:] - 1, len(own)]):
            where = (tree[tails[r]], old[tails[r]])
            above[where] = max(n, above.get(where, 0))
        known = np.array([(tree[r], old[r]) in above for r in heads])[own]
        parent = number - 1
        parent[begins] = [-1 if seg[heads[r]] == 1 else above.get((tree[heads[r]], old[heads[r]]), -1) for r in own[begins]]
        kept = pa.array(np.flatnonzero(known))
        columns = {c: t.column(c).take(pa.array(heads[own])) for c in (KEY, *SEGMENT)}
        columns |= {"point_no": pa.array(number, pa.int32()), "parent": pa.array(parent, pa.int32()), "s": pa.array(along)}
        columns |= {c: pa.array(places[:, i], mask=gone[:, i]) for i, c in enumerate("xyz")}
        return pa.table(columns).take(kept)

    rows = with_places(segments, points).select(KEY, *SEGMENT, "pos", "point_no", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    names = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return rows.groupBy(KEY).applyInArrow(run, f"{names}, point_no int, parent int, s double, x double, y double, z double")


def divide_segments(segments: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """Every segment cut into ``n`` pieces of equal length: ``part`` 0..n with its place."""
    if n < 1:
        raise ValueError("a line needs one piece at least")
    line = _led(measured(segments, points))
    total = line.where("s1 is null and s > 0").select(KEY, *SEGMENT, F.col("s").alias("total"))
    line = line.join(total, [KEY, *SEGMENT])
    first, last = F.floor(F.col("s") * n / F.col("total")) + 1, F.ceil(F.col("s1") * n / F.col("total")) - 1
    spots = F.when(last >= first, F.transform(F.sequence(first, last), lambda i: i))
    share = F.try_divide(F.col("part") * F.col("total") / n - F.col("s"), F.col("s1") - F.col("s"))
    exact = line.where((F.col("s") > 0) & F.col("s1").isNotNull() & (F.col("s") * n / F.col("total") == F.floor(F.col("s") * n / F.col("total"))))
    inner = line.where("s1 is not null").select("*", F.explode(spots).alias("part"))
    inner = inner.select(KEY, *SEGMENT, F.col("part").cast("int").alias("part"), *[(F.col(a) + share * (F.col(a + "1") - F.col(a))).alias(a) for a in "xyz"])
    on = exact.select(KEY, *SEGMENT, F.floor(F.col("s") * n / F.col("total")).cast("int").alias("part"), *"xyz")
    ends = line.where("pos = 0 or s1 is null").select(KEY, *SEGMENT, F.when(F.col("pos") == 0, 0).otherwise(n).alias("part"), *"xyz")
    return inner.unionByName(on).unionByName(ends).dropDuplicates([KEY, *SEGMENT, "part"])


def smooth_segments(segments: DataFrame, points: DataFrame, weights: tuple[float, ...] = (0.25, 0.5, 0.25)) -> DataFrame:
    """Weighted moving average inside segments longer than the filter; their ends stay."""
    n, half = len(weights), len(weights) // 2
    w = _along()
    size = F.count("*").over(Window.partitionBy(KEY, *SEGMENT))
    inside = (F.col("pos") >= half) & (F.col("pos") < size - half) & (size > n)
    rows = with_places(segments, points)
    mixed = {a: sum(float(x) * F.lead(a, k - half).over(w) for k, x in enumerate(weights)) / float(sum(weights)) for a in "xyz"}
    smooth = rows.select(KEY, *SEGMENT, "pos", "point_no", *[F.when(inside, mixed[a]).otherwise(F.col(a)).alias(a) for a in "xyz"])
    return smooth


def longest_segment(segments: DataFrame, points: DataFrame) -> DataFrame:
    """The points of each neuron's longest segment (ties: the first)."""
    lengths = segment_lengths(segments, points)
    top = lengths.groupBy(KEY).agg(F.max_by(F.struct(*SEGMENT), F.struct("length", -F.col("tree_no"), -F.col("seg_no"))).alias("t")).select(KEY, "t.*")
    return with_places(segments.join(top, [KEY, *SEGMENT], "left_semi"), points)


def _per_segment(rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray], extra: str) -> DataFrame:
    """``fn`` of each segment's (n, 3) places in order; a neuron's segments share one Arrow call."""
    kind = rows.schema[KEY].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in (*SEGMENT, "pos")])
        own = np.stack([t.column(c).to_numpy() for c in SEGMENT])
        cuts = np.flatnonzero(np.r_[True, (own[:, 1:] != own[:, :-1]).any(axis=0), True])
        xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1).astype(float)
        made = [fn(xyz[a:b]) for a, b in zip(cuts, cuts[1:])]
        sizes = np.array([len(m) for m in made])
        at = pa.array(np.repeat(cuts[:-1], sizes))
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        places = np.concatenate(made)
        return pa.table({**{c: t.column(c).take(at) for c in (KEY, *SEGMENT)}, "pos": pa.array(pos, pa.int32()), **{c: pa.array(places[:, i]) for i, c in enumerate("xyz")}})

    return rows.select(KEY, *SEGMENT, "pos", *"xyz").groupBy(KEY).applyInArrow(run, f"{KEY} {kind}, tree_no int, seg_no int, pos int, x double, y double, z double" + extra)


def spline_smooth(segments: DataFrame, points: DataFrame, strength: float = 1.0, end_weight: float = 1e6) -> DataFrame:
    """Penalised least squares along each segment (second differences), ends held by their weight."""

    def fit(xyz: np.ndarray) -> np.ndarray:
        n = len(xyz)
        if n < 4:
            return xyz
        weight = np.ones(n)
        weight[[0, -1]] = end_weight
        bend = np.diff(np.eye(n), 2, axis=0)
        return np.linalg.solve(np.diag(weight) + strength * bend.T @ bend, weight[:, None] * xyz)

    return _per_segment(with_places(segments, points), fit, "")


def bspline_smooth(segments: DataFrame, points: DataFrame, spacing: float = 5.0, per_point: int = 1) -> DataFrame:
    """Uniform cubic B-spline through control points every ``spacing`` of length, clamped at the ends."""

    def fit(xyz: np.ndarray) -> np.ndarray:
        s = np.r_[0, np.cumsum(np.sqrt((np.diff(xyz, axis=0) ** 2).sum(axis=1)))]
        if len(xyz) < 4 or s[-1] == 0:
            return xyz
        knots = np.linspace(0, s[-1], max(4, int(s[-1] // spacing) + 1))
        control = np.stack([np.interp(knots, s, xyz[:, i]) for i in range(3)], axis=1)
        control = np.concatenate([control[:1], control[:1], control, control[-1:], control[-1:]])
        u = np.interp(s, [0, s[-1]], [0, len(control) - 3]) if per_point == 1 else np.linspace(0, len(control) - 3, per_point * len(xyz))
        i = np.minimum(u.astype(int), len(control) - 4)
        f = u - i
        basis = np.stack([(1 - f) ** 3, 3 * f**3 - 6 * f**2 + 4, -3 * f**3 + 3 * f**2 + 3 * f + 1, f**3], axis=1) / 6
        return sum(basis[:, [k]] * control[i + k] for k in range(4))

    return _per_segment(with_places(segments, points), fit, "")
