"""N-gram Jaccard join over signature trees.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; a document's
set holds its distinct ``k``-word shingles (with fewer words, the whole sequence
as one; without words it is empty and linked with nothing).  Two documents link
when ``100 * |A & B| >= percent * |A | B|``.

How it runs:

1. Equal sets collapse to one class.
2. Any two linked sets share one of the first ``n - ceil(t n) + 1`` shingles in
   a common order.  The order puts corpus-wide frequent shingles last (counts
   from a fixed-size sketch; any order is lossless) and a count-min sketch drops
   prefix shingles that no second class holds.  Shingles held by the same
   classes count once.
3. The classes behind each remaining shingle, by ranges of set size, form signature trees
   (groups that cannot hold a pair's first common shingle are left out): leaves hold
   token bitmaps and sizes, inner nodes the OR of their children's bitmaps, the
   size range and the largest collision slack.  Dual traversal drops node pairs
   whose greatest possible overlap is too small.  What survives is joined into
   candidate clusters (one row a class, never all pairs).
4. Within each candidate cluster a second dual traversal over wider bitmaps ends
   in exact overlaps of full sets; pairs already connected are passed over, as
   they cannot change the components.

Groups above a bound are cut into blocks and joined block by block.  Shingles
are compared by 64-bit hashes.

Null or blank text: ``n_shingles`` 0, its own component (null ``doc_id`` stays
null).  Repeated rows link like any equal texts.  Texts of any length are read
whole; one unbroken word is one shingle.  Other columns are not read.  An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, RepeatSketch, connected_components, discard, hash_words, materialize, mix64, signed, slices, window_hashes

#: Counters of the frequency sketch (fixed size) and members of a tree block.
FREQUENCY_BITS, FREQUENCY_BLOCKS = 20, 64
BLOCK, LEAF, FANOUT = 4096, 4, 4
#: Candidate classes whose keys may be broadcast to read their texts (32 bytes each).
BROADCAST_ROWS = 500_000
#: Set elements that one exact cluster task holds.
CLUSTER_ELEMENTS = 6_000_000


def _sets(texts: list, k: int) -> Iterator[np.ndarray]:
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        yield set_of(hash_words(words), k)


def set_of(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=U64)
    return np.unique(window_hashes(hashes, k) if n >= k else window_hashes(hashes, n))


def class_key(s: np.ndarray) -> int:
    """64-bit hash of a whole set."""
    folded = np.bitwise_xor.reduce(mix64(s + U64(len(s)))) ^ np.add.reduce(mix64(s ^ U64(0x5851F42D4C957F2D)))
    return int(mix64(np.array([folded])).view(np.int64)[0])


# ------------------------------------------------------------- frequency classes
def frequency_classes(docs: DataFrame, k: int) -> np.ndarray:
    """uint8 per counter: 0 for ordinary shingles, more for frequent ones."""
    width, per = 1 << FREQUENCY_BITS, (1 << FREQUENCY_BITS) // FREQUENCY_BLOCKS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(width, dtype=np.uint32), 0
        for batch in slices(batches):
            for s in _sets(batch.column(0).to_pylist(), k):
                np.add.at(totals, (s >> U64(64 - FREQUENCY_BITS)).astype(np.int64), 1)
                n += len(s)
        if n:
            parts = [zlib.compress(totals[i * per : (i + 1) * per].tobytes(), 1) for i in range(FREQUENCY_BLOCKS)]
            yield pa.record_batch([pa.array(range(FREQUENCY_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(part), dtype=np.uint32)
                sums[block] = sums.get(block, 0) + part.astype(np.int64)
        for block, total in sums.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    schema = "block int, part binary"
    merged = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(merge, schema)
    totals = np.zeros(width, dtype=np.int64)
    for block, part in merged.collect():  # 8 bytes a counter, whatever the input
        totals[block * per : (block + 1) * per] = np.frombuffer(part, dtype=np.int64)
    usual = 4 * totals.mean() + 64
    return np.where(totals > usual, 1 + np.log2(np.maximum(totals, 1) / usual), 0).astype(np.uint8)


# --------------------------------------------------------------------- bitmaps
def bitmap_width(n: int, times: int) -> int:
    """Bits of a set's bitmap: a power of two, ``times`` to twice ``times`` its size.

    At one bit an element two unrelated sets of n still share at most 0.77 n by the
    bound, below the 0.89 n that a similarity of 0.8 asks.
    """
    return max(64, 1 << int(times * n - 1).bit_length())


def bitmap(members: np.ndarray, width: int) -> np.ndarray:
    """uint64 words; narrower bitmaps are folds of wider ones (low bits index)."""
    bits = np.zeros(width, dtype=np.uint8)
    bits[(mix64(members) & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(U64)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, width // 64), axis=0)


class UnionFind:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                return up
            self.up = up = nxt


class SignatureTree:
    """Levels of nodes from leaves up: OR bitmap, size range, largest slack."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        slack = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.levels = [(words, sizes, sizes, slack)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            words, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), step)
            self.levels.append((np.bitwise_or.reduceat(words, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))
            step = FANOUT


def may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some pair below nodes i of ``a`` and j of ``b`` can reach the threshold.

    Common bits bound common shingles: every shingle of one side adds a bit of
    its own but for its collision slack.
    """
    (wa, la, ha, sa), (wb, lb, hb, sb) = a, b
    low_a, high_a, low_b, high_b = la[i], ha[i], lb[j], hb[j]
    ok = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    kept = np.flatnonzero(ok)
    if len(kept):
        common = np.bitwise_count(wa[i[kept]] & wb[j[kept]]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(common + np.minimum(sa[i[kept]], sb[j[kept]]), np.minimum(high_a, high_b)[kept])
        ok[kept] = (100 + percent) * overlap >= percent * (low_a + low_b)[kept]
    return ok


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool, percent: int, limit: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves' members that may link, in bounded lots."""
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(min(top, len(a.levels) - 1), min(top, len(b.levels) - 1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > limit:
            stack += [(la, lb, i[s : s + limit], j[s : s + limit]) for s in range(0, len(i), limit)]
            continue
        ok = may_link(a.levels[la], b.levels[lb], i, j, percent)
        if same and la == lb:
            ok &= (i <= j) if la else (i < j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == lb == 0:
            yield i, j
            continue
        if la >= lb:
            i, j = _children(i, j, la, len(a.levels[la - 1][1]))
            la -= 1
            if same:  # both sides of one tree go down together
                j, i = _children(j, i, lb, len(b.levels[lb - 1][1]))
                lb -= 1
        else:
            j, i = _children(j, i, lb, len(b.levels[lb - 1][1]))
            lb -= 1
        stack.append((la, lb, i, j))


def _children(i: np.ndarray, j: np.ndarray, level: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    step = LEAF if level == 1 else FANOUT
    child = (i[:, None] * step + np.arange(step)).ravel()
    mate = np.repeat(j, step)
    real = child < below
    return child[real], mate[real]


def links_by_width(words: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs among members; across sides only, where there are two.

    Bitmaps are as wide as their set is large; pairs of different widths are
    compared at the narrower one.
    """
    widths = np.array([64 * len(w) for w in words])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        reach = sizes[own].max()
        wider = np.flatnonzero((widths > width) & (percent * sizes <= 100 * reach))
        groups = [own[side[own] == s] for s in (0, 1)], [wider[side[wider] == s] for s in (0, 1)]
        tree: dict[tuple[int, int], tuple[SignatureTree, np.ndarray]] = {}
        for kind in (0, 1):
            for s in (0, 1):
                ids = groups[kind][s]
                if len(ids):
                    rows = np.stack([words[x] if len(words[x]) * 64 == width else fold(words[x], int(width)) for x in ids])
                    order = np.lexsort((rows[:, 0], sizes[ids]))
                    tree[kind, s] = SignatureTree(rows[order], sizes[ids][order]), ids[order]
        two = bool((side == 1).any())
        for x, y in ([((0, 0), (0, 1)), ((0, 0), (1, 1)), ((0, 1), (1, 0))] if two else [((0, 0), (0, 0)), ((0, 0), (1, 0))]):
            if x in tree and y in tree:
                (ta, ia), (tb, ib) = tree[x], tree[y]
                for i, j in dual_traversal(ta, tb, x == y, percent):
                    yield ia[i], ib[j]


# ------------------------------------------------------------- streaming groups
def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal first ``keys`` columns, across batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(int(c[lo]) for c in columns)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)


def _block_pairs(count: str, key: str):
    """Rows for every pair of blocks that holds this one's block (one pair if few).

    A group of ``blocks`` blocks is joined as pairs of blocks, so that no task
    holds more than two of them.
    """
    own = F.pmod(F.xxhash64(key), F.col(count))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), lambda b: F.struct(F.least(own, b).alias("i"), F.greatest(own, b).alias("j")))
    return own, pair


def _in_blocks(df: DataFrame, group: str, count: str, key: str) -> DataFrame:
    own, pair = _block_pairs(count, key)
    return df.withColumn("side", own).withColumn("pair", F.explode(pair)).withColumn("i", F.col("pair.i")).withColumn("j", F.col("pair.j")).withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise(F.when(F.col("side") == F.col("j"), 1).otherwise(0)).cast("int")).drop("pair")


def _star(ids: np.ndarray, joined: UnionFind) -> tuple[np.ndarray, np.ndarray]:
    roots = joined.roots()
    at = np.flatnonzero(roots != np.arange(len(roots)))
    return ids[at], ids[roots[at]]


def _edge_batches(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    left, right, held = [], [], 0
    for a, b in found:
        left.append(a)
        right.append(b)
        held += len(a)
        if held >= 20_000:
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
            left, right, held = [], [], 0
    if held:
        yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


# ----------------------------------------------------------------------- the join
def ngram_jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("row_key", F.coalesce("doc_id", F.xxhash64("text")))
    heavy = spark.sparkContext.broadcast(frequency_classes(docs, k))

    def signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = heavy.value
        for batch in slices(batches):
            n, key, prefix, words = [], [], [], []
            for s in _sets(batch.column(1).to_pylist(), k):
                n.append(len(s))
                if not len(s):
                    key.append(None), prefix.append(None), words.append(None)
                    continue
                key.append(class_key(s))
                rank = classes[(s >> U64(64 - FREQUENCY_BITS)).astype(np.int64)]
                ordered = s[np.argsort(rank, kind="stable")] if rank.any() else s
                prefix.append(ordered[: len(s) - (percent * len(s) + 99) // 100 + 1].tobytes())
                words.append(bitmap(s, bitmap_width(len(s), 1)).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(prefix, pa.binary()), pa.array(words, pa.binary())], names=["doc_id", "row_key", "n_shingles", "cls", "prefix", "bits"])

    sig = materialize(docs.mapInArrow(signatures, "doc_id long, row_key long, n_shingles long, cls long, prefix binary, bits binary"), "signatures")
    # rep: the class's smallest doc_id; at: the row through which its text is read
    classes = sig.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("at"), *(F.first(c).alias(c) for c in ("n_shingles", "prefix", "bits")))
    classes = materialize(classes, "classes")
    slim = materialize(sig.select("doc_id", "n_shingles", "cls"), "document-classes")
    discard(sig)

    # ---- postings of prefix shingles that another class may hold
    items = classes.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0.0
    sketch = RepeatSketch.for_items(items, max_bits=28)

    def touch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size >= 32_000_000:
                    yield sketch.emit(np.frombuffer(b"".join(held), dtype=U64))
                    held, size = [], 0
        if held:
            yield sketch.emit(np.frombuffer(b"".join(held), dtype=U64))

    table = spark.sparkContext.broadcast(sketch.merge(classes.select("prefix").mapInArrow(touch, "block long, part binary")))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_pylist()
            lengths = np.array([len(x) // 8 for x in parts], dtype=np.int64)
            tokens = np.frombuffer(b"".join(parts), dtype=U64)
            owner = np.repeat(batch.column(0).to_numpy(), lengths)
            kept = sketch.repeated(table.value, tokens)
            sizes = batch.column(2).to_numpy()
            size = np.repeat(sizes, lengths)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            lead = place < np.repeat(sizes - (2 * percent * sizes + 99 + percent) // (100 + percent) + 1, lengths)
            yield pa.record_batch([signed(tokens[kept]), pa.array(owner[kept]), pa.array(size[kept]), pa.array(lead[kept])], names=["token", "cls", "n_shingles", "lead"])

    # Sizes fall into ranges a threshold's ratio wide; linked sets lie in the same
    # or in neighbouring ranges, so every class joins its own and the next.  The
    # overlap of a linked pair is at least 2t/(1+t) of its smaller set, so the first
    # shingle they share lies in that set's shorter lead; and pairs of a range below
    # met in that range: groups without a lead, or without a class of their own
    # range, hold no link of their own.
    size_range = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")
    postings = classes.select("cls", "prefix", "n_shingles").mapInArrow(post, "token long, cls long, n_shingles long, lead boolean")
    postings = materialize(postings.withColumn("sizes", size_range).drop("n_shingles"), "postings")
    postings = postings.select("token", "cls", "lead", F.posexplode(F.array("sizes", F.col("sizes") + 1)).alias("above", "sizes"))
    groups = postings.groupBy("token", "sizes").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.sum(F.hash("cls").cast("long")).alias("y"), F.max("lead").alias("lead"), F.min("above").alias("above"))
    groups = groups.where("n > 1 and lead and above = 0")
    groups = groups.groupBy("n", "x", "y").agg(F.min(F.struct("token", "sizes")).alias("g")).select("g.token", "g.sizes", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = postings.select("token", "sizes", "cls").join(groups, ["token", "sizes"]).join(classes.select("cls", "n_shingles", "bits"), "cls")
    rows = _in_blocks(rows, "token", "blocks", "cls").select("token", F.col("sizes").cast("long").alias("sizes"), "i", "j", "cls", "side", "n_shingles", "bits")

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, t in runs(batches, 4):
                if t.num_rows < 2:
                    continue
                ids, side, sizes = (t.column(c).to_numpy() for c in (4, 5, 6))
                words = [np.frombuffer(x, dtype=U64) for x in t.column(7).to_pylist()]
                joined = UnionFind(len(ids))
                for a, b in links_by_width(words, sizes, side, percent):
                    _unite(joined, a, b)
                yield _star(ids, joined)

        return _edge_batches(found())

    loose = rows.repartition("token", "sizes", "i", "j").sortWithinPartitions("token", "sizes", "i", "j").mapInArrow(candidates, "a long, b long")
    clusters = materialize(connected_components(loose, "candidates").withColumnsRenamed({"node": "cls", "component": "cluster"}), "clusters")

    # ---- exact overlaps within candidate clusters
    members = clusters.join(classes.select("cls", F.col("at").alias("row_key"), "n_shingles"), "cls")
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / CLUSTER_ELEMENTS).alias("blocks"))
    members = members.join(blocks, "cluster").select("cls", "cluster", "blocks", "row_key")
    if clusters.count() <= BROADCAST_ROWS:  # four longs a row; beyond, a shuffled join
        members = F.broadcast(members)
    texts = docs.select("row_key", "text").join(members, "row_key").select("cls", "cluster", "blocks", "text")

    def whole_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(_sets(batch.column(3).to_pylist(), k))
            # rows that share an id may hold other texts: only the class's own counts
            own = [i for i, (s, c) in enumerate(zip(sets, batch.column(0).to_pylist())) if len(s) and class_key(s) == c]
            kept = pa.record_batch(batch.columns[:3], names=["cls", "cluster", "blocks"]).take(pa.array(own, pa.int64()))
            yield pa.record_batch([*kept.columns, pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["cls", "cluster", "blocks", "members"])

    rows = texts.mapInArrow(whole_sets, "cls long, cluster long, blocks long, members binary")
    rows = _in_blocks(rows, "cluster", "blocks", "cls").select("cluster", "i", "j", "cls", "side", "members")

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, t in runs(batches, 3):
                ids, side = t.column(3).to_numpy(), t.column(4).to_numpy()
                sets = [np.frombuffer(x, dtype=U64) for x in t.column(5).to_pylist()]
                yield _star(ids, exact_links(sets, side, percent))

        return _edge_batches(found())

    links = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(exact, "a long, b long")
    linked = connected_components(links, "links")
    named = classes.select("cls", "rep").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(names, "component").select("cls", "component_id"), "components")
    out = slim.join(named, "cls", "left")
    discard(postings), discard(clusters), discard(classes)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _unite(joined: UnionFind, a: np.ndarray, b: np.ndarray) -> None:
    """Unite pairs; those already together are dropped in bulk first."""
    while len(a):
        roots = joined.roots()
        apart = roots[a] != roots[b]
        a, b = roots[a[apart]], roots[b[apart]]
        if not len(a):
            return
        # each root takes its smallest partner, then the rest is seen again
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((low, high))
        low, high = low[order], high[order]
        first = np.r_[True, high[1:] != high[:-1]]
        joined.up[high[first]] = low[first]
        a, b = low[~first], high[~first]


def exact_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> UnionFind:
    """Components of exact links among sets whose pairs are not yet connected."""
    joined = UnionFind(len(sets))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) < 2:
        return joined
    words = [bitmap(s, bitmap_width(len(s), 8)) for s in sets]
    for a, b in links_by_width(words, sizes, side, percent):
        roots = joined.roots()
        apart = roots[a] != roots[b]
        a, b = a[apart], b[apart]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
        for lo, hi in zip(starts, [*starts[1:], len(a)]):
            one, others = int(a[lo]), b[lo:hi]
            root, base = joined.find(one), sets[one]
            for other in others.tolist():
                there = joined.find(other)
                if there == root:
                    continue
                mine = sets[other]
                common = np.count_nonzero(base[np.minimum(np.searchsorted(base, mine), len(base) - 1)] == mine)
                if 100 * common >= percent * (len(base) + len(mine) - common):
                    joined.union(root, there)
                    root = joined.find(root)
    return joined
