"""SimHash near-dedup: 64-bit fingerprints, linked through binary tries.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z.  A text's
features are its ``k``-word shingles, repeats included and space-joined (with
fewer words the whole sequence as one); each is hashed by XXH64 of its UTF-8
bytes with seed 42.  A fingerprint bit is 1 if it is set in over half of the
hashes.  Fingerprints link at ``most`` or fewer differing bits.

How it runs:

1. Each distinct fingerprint is one class, whatever the number of its texts.
2. The 64 bits are cut into blocks, ``most`` fewer of which must agree in any
   linked pair: every choice of that many blocks is a key, and each class is
   dealt to its group under every key (five groups with five blocks; more blocks,
   agreeing in several, where the number of classes asks for longer keys).
3. Within a group a binary trie of the fingerprints (chains of single children
   are one edge) is joined with itself: pairs of nodes go down together, adding
   up the bits in which their prefixes differ, and a pair is dropped once that
   exceeds the budget.  The budget grows in steps, and pairs of nodes whose leaves
   are all connected already are passed over.  A group leaves one edge a class.
4. Components of these edges, named by their smallest document.

Groups above ``BLOCK`` classes are joined as pairs of blocks.  No pairs of
documents are listed, and copies never meet.

Null text or one without words: fingerprint zero, linked like any other.  Null
``doc_id``: the row links, but names no component unless all rows of its component
have none (then null).  Repeated rows link like any equal texts.  Texts of any
length are read whole.  Other columns are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, connected_components, discard, materialize, signed, slices
from .ngram_join import UnionFind, _edge_batches, _star, _unite, runs

SEED = 42
#: Classes that one trie holds, those dealt to a group on average at most, and node pairs looked at together.
BLOCK, GROUP, LOT = 8192, 512, 400_000
#: Hashes of texts counted together.
HELD = 1_000_000


# ------------------------------------------------------------------ fingerprints
def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every shingle of a text, in order, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=U64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    span = min(k, len(words))
    starts = np.r_[0, ends[: len(words) - span] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[span - 1 :].tolist())), dtype=U64, count=len(starts))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each consecutive run of ``sizes`` hashes (zero for none).

    Eight bits a word are counted in the bytes of one sum, over at most 255 hashes
    at a time; those counts are added up for each text.
    """
    out = np.zeros(len(sizes), dtype=U64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    lots = -(-sizes // 255)
    first = np.cumsum(lots) - lots
    text_start = np.cumsum(sizes) - sizes
    starts = np.repeat(text_start - 255 * first, lots) + 255 * np.arange(lots.sum())
    found = np.zeros(len(sizes), dtype=U64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> U64(j)) & U64(0x0101010101010101), starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):  # little-endian: byte b holds bits 8 b + j
            found |= (2 * counts[:, byte] > sizes).astype(U64) << U64(8 * byte + j)
    out[full] = found
    return out


def fingerprints(texts: Iterable[str | None], k: int) -> np.ndarray:
    parts, held, sizes, total = [], [], [], 0
    for text in texts:
        held.append(shingle_hashes(text, k))
        sizes.append(len(held[-1]))
        total += sizes[-1]
        if total >= HELD:
            parts.append(majority(np.concatenate(held), np.array(sizes)))
            held, sizes, total = [], [], 0
    if sizes:
        parts.append(majority(np.concatenate(held), np.array(sizes)))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=U64)


# ------------------------------------------------------------------------- tries
def _length(x: np.ndarray) -> np.ndarray:
    """Position of the highest set bit plus one (0 for 0)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> U64(s))
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """Binary tries over runs of ascending distinct fingerprints, one a group.

    Node: leaves ``lo..hi``, the ``depth`` bits that they share, children (-1: none).
    """

    def __init__(self, prints: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.prints = prints
        lo, hi = [np.asarray(starts, np.int64)], [np.asarray(ends, np.int64)]
        depth, left, right, made = [], [], [], 0
        while len(lo[-1]):
            a, b = lo[-1], hi[-1]
            rest = _length(prints[a] ^ prints[b - 1])
            depth.append(64 - rest)
            inner = np.flatnonzero(b - a > 1)
            bit = U64(1) << (rest[inner] - 1).astype(U64)
            low, high = a[inner], b[inner]
            while (open_ := low < high).any():  # first leaf whose next bit is set
                middle = (low + high) // 2
                one = (prints[np.minimum(middle, len(prints) - 1)] & bit) != 0
                high = np.where(open_ & one, middle, high)
                low = np.where(open_ & ~one, middle + 1, low)
            made += len(a)
            child = np.full((2, len(a)), -1, dtype=np.int64)
            child[0, inner] = made + np.arange(len(inner))
            child[1, inner] = made + len(inner) + np.arange(len(inner))
            left.append(child[0]), right.append(child[1])
            lo.append(np.r_[a[inner], low]), hi.append(np.r_[low, b[inner]])
        self.roots = len(lo[0])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.lo, self.hi, self.depth, self.left, self.right = map(join, (lo[:-1], hi[:-1], depth, left, right))
        self.met = 0

    def components(self, most: int) -> UnionFind:
        """Components of the links within each trie."""
        joined = UnionFind(len(self.prints))
        for budget in sorted({min(most, b) for b in (1, 2, most)}):
            self._join(budget, joined)
        return joined

    def _united(self, joined: UnionFind) -> np.ndarray:
        """For each node the one component of all its leaves, or -1."""
        if not len(self.lo):
            return np.zeros(0, np.int64)
        roots = np.r_[joined.roots(), 0]
        ranges = np.stack([self.lo, self.hi], axis=1).ravel()
        least, largest = np.minimum.reduceat(roots, ranges)[::2], np.maximum.reduceat(roots, ranges)[::2]
        return np.where(least == largest, least, -1)

    def _join(self, budget: int, joined: UnionFind) -> None:
        """Unite the leaves of all pairs that differ in ``budget`` bits or fewer."""
        one = self._united(joined)
        root = np.arange(self.roots)
        stack = [(root, root, np.zeros(self.roots, np.int64), np.zeros(self.roots, np.int64))]
        while stack:
            a, b, seen, differ = stack.pop()
            if len(a) > LOT:
                stack += [tuple(x[s : s + LOT] for x in (a, b, seen, differ)) for s in range(0, len(a), LOT)]
                continue
            self.met += len(a)
            # bits between the prefixes compared so far and the shorter of both
            shared = np.minimum(self.depth[a], self.depth[b])
            x = self.prints[self.lo[a]] ^ self.prints[self.lo[b]]
            x = np.where(seen > 0, x & ((U64(1) << (64 - np.maximum(seen, 1)).astype(U64)) - U64(1)), x)
            x = np.where(shared > 0, x >> (64 - np.maximum(shared, 1)).astype(U64), U64(0))
            differ = differ + np.bitwise_count(x)
            keep = (differ <= budget) & ~((one[a] == one[b]) & (one[a] >= 0))
            a, b, shared, differ = a[keep], b[keep], shared[keep], differ[keep]
            leaf_a, leaf_b = self.left[a] < 0, self.left[b] < 0
            done = leaf_a & leaf_b
            i, j = self.lo[a[done]], self.lo[b[done]]
            if len(i):
                _unite(joined, i[i != j], j[i != j])
            same = np.flatnonzero(~done & (a == b))
            if len(same):
                l, r = self.left[a[same]], self.right[a[same]]
                # the children of one node differ in the bit after its prefix
                stack.append(tuple(np.concatenate(c) for c in ((l, r, l), (l, r, r), (shared[same],) * 3, (differ[same],) * 3)))
            apart = np.flatnonzero(~done & (a != b))
            if len(apart):
                x, y = a[apart], b[apart]
                # the node with the shorter prefix goes down
                down_a = ~leaf_a[apart] & (leaf_b[apart] | (self.depth[x] <= self.depth[y]))
                x, y = np.where(down_a, x, y), np.where(down_a, y, x)
                stack.append(tuple(np.concatenate(c) for c in ((self.left[x], self.right[x]), (y, y), (shared[apart],) * 2, (differ[apart],) * 2)))


# ----------------------------------------------------------------------- the join
def keys_for(classes: int, most: int) -> list[int]:
    """Masks of the bits that a key keeps: one for every choice of agreeing blocks."""
    blocks = most + 1
    while blocks < 2 * most + 1 and classes / 2 ** (64 * (blocks - most) / blocks) > GROUP:
        blocks += 1
    edges = [64 * b // blocks for b in range(blocks + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - most)]


def links(classes: DataFrame, most: int) -> DataFrame:
    """``a, b``: edges that connect the fingerprints ``fp`` (distinct) within ``most`` bits."""
    masks = keys_for(classes.count(), most)
    as_long = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    key = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(as_long)]))
    dealt = classes.select("fp", key.alias("key")).select("key.part", "key.value", "fp")
    groups = materialize(dealt.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).drop("n"), "fingerprint-groups")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # a group of several blocks is joined as pairs of two different blocks
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: (F.col("blocks") == 1) | (b != own))
    pair = F.explode(F.transform(others, lambda b: F.struct(F.least(own, b).alias("i"), F.greatest(own, b).alias("j"))))
    rows = dealt.join(groups, ["part", "value"]).select("part", "value", pair.alias("p"), "fp").select("part", "value", "p.i", "p.j", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tries(lots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            ends = np.cumsum([len(x) for x in lots])
            prints = np.concatenate(lots)
            forest = Forest(prints, np.r_[0, ends[:-1]], ends)
            return _star(prints.view(np.int64), forest.components(most))

        def found():
            held, size = [], 0
            for _, t in runs(batches, 4):
                held.append(np.sort(t.column(4).to_numpy().view(U64)))
                size += t.num_rows
                if size >= 8 * BLOCK:
                    yield tries(held)
                    held, size = [], 0
            if held:
                yield tries(held)

        return _edge_batches(found())

    return rows.repartition("part", "value", "i", "j").sortWithinPartitions("part", "value", "i", "j").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, k: int = 5, most: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), signed(fingerprints((x.as_py() for x in batch.column(1)), k))], names=["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = materialize(docs.mapInArrow(run, "doc_id long, fp long"), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    linked = materialize(connected_components(links(classes, most), "fingerprint-links"), "fingerprint-components")
    named = classes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "fingerprint-named")
    names = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")), "fingerprint-names")
    by_print = materialize(named.join(names, "component").select("fp", "component_id"), "fingerprint-answers")
    for done in (classes, linked, named, names):
        discard(done)
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
