"""Substring dedup: repeated word windows, found through a count-min prefilter.

Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged.  A window is ``k``
consecutive words of one document.  Each word covered by a window whose word
sequence also starts anywhere else (same document included) is removed; windows
are judged on the input.

How it runs:

1. Every window is represented by its anchor: the smallest hash among the short
   word grams inside it.  Equal windows have equal anchors, and an anchor's
   number of places is at least its windows' count, so a count-min sketch over
   anchor places (a fourteenth of the windows) overestimates window counts.
   Partition sketches are merged; the bitmap "reached two" is broadcast (its
   size is fixed by the sketch, see ``RepeatSketch.for_items``).
2. Only windows estimated repeated are listed (once, in a table), with their
   counts within a text, and grouped exactly by 64-bit hash, counts being added
   up on the map side.  The repeated ones are written before they meet the list
   again, so that both sides of that join are plain shuffles, which adaptive
   execution splits where one passage is everywhere.
3. Each document gets the set of its repeated windows and drops their words.

Beyond the sketch's largest size the estimate passes more windows on to the
exact pass; it never loses one.

Null text: no words.  Null or repeated ``doc_id``: rows are judged by their own
words.  A text that repeats a window within itself loses every occurrence, one
unbroken word of any length is one word, and texts of millions of words are
judged whole.  Empty tables give empty results.  Columns other than ``doc_id``
and ``text`` pass through untouched whatever their names, but for older ones
named like an output of :func:`judge_windows`, which replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BOX, U64, RepeatSketch, ascii_words, boxed, chunked, hash_words, materialize, schema_of, signed, slices, unboxed, window_hashes

#: Words of the grams among which a window's anchor is chosen.
GRAM = 8
#: log2 of the sketch's counters a row at most: two rows' bitmaps take 134 MB.
SKETCH_BITS = 29
KEY, HITS = "__row_key", "__windows"


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(word_hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window, and the anchors of all anchor places."""
    gram = min(GRAM, k)
    grams = window_hashes(word_hashes, gram)
    span = k - gram + 1
    if len(grams) < span:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)
    least = _sliding(grams, span, np.minimum)
    # a gram is an anchor place if it is the least of some window over it
    padded = np.concatenate([np.zeros(span - 1, dtype=U64), least, np.zeros(span - 1, dtype=U64)])
    return least, grams[_sliding(padded, span, np.maximum) == grams]


def covered_words(n: int, repeated: np.ndarray, k: int) -> np.ndarray:
    """True for each of ``n`` words inside a window of ``repeated`` (by start)."""
    steps = np.zeros(n + 1, dtype=np.int32)
    starts = np.flatnonzero(repeated)
    steps[starts] += 1
    steps[starts + k] -= 1
    return np.cumsum(steps[:n]) > 0


def repeated_windows(docs: DataFrame, k: int) -> DataFrame:
    """``row_key, windows``: for each text that has any, its repeated windows.

    ``windows`` holds the hashes (little-endian 64-bit) of windows that start at
    two places or more in the table.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    sketch = RepeatSketch.for_items(chars / 5 / max(1.0, (k - min(GRAM, k) + 2) / 2), max_bits=SKETCH_BITS)

    def touch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                places = anchors(hash_words(ascii_words(text)), k)[1]
                if len(places):
                    held.append(places)
                    size += len(places)
                if size >= 4_000_000:
                    yield sketch.emit(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield sketch.emit(np.concatenate(held))

    table = spark.sparkContext.broadcast(sketch.merge(docs.select("text").mapInArrow(touch, "block long, part binary")))

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo, hi in chunked(texts):
                owner, window, times = [], [], []
                for row_key, text in zip(ids[lo:hi], texts[lo:hi]):
                    hashes = hash_words(ascii_words(text))
                    least, _ = anchors(hashes, k)
                    if not len(least):
                        continue
                    maybe = sketch.repeated(table.value, least)
                    if maybe.any():
                        found, count = np.unique(window_hashes(hashes, k)[maybe], return_counts=True)
                        window.append(found)
                        times.append(count)
                        owner.append(np.full(len(found), row_key, dtype=np.int64))
                if owner:
                    yield pa.record_batch([signed(np.concatenate(window)), pa.array(np.concatenate(owner)), pa.array(np.minimum(np.concatenate(times), 2).astype(np.int32))], names=["window", "row_key", "n"])

    rows = docs.select("row_key", "text").mapInArrow(candidates, "window long, row_key long, n int")
    rows = materialize(rows, "windows")
    repeated = materialize(rows.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window"), "repeated-windows")
    hits = rows.select("window", "row_key").join(repeated, "window").groupBy("row_key").agg(F.collect_set("window").alias("windows"))
    return hits


def judge_windows(docs: DataFrame, k: int = 35, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``n_words, n_removed, kept_sha256`` (``kept_text``; else without ``text``)."""
    read = ("doc_id", "text")
    keyed = boxed(docs, *read).withColumn("text", F.col("text").cast("string")).withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    hits = repeated_windows(keyed.select(F.col(KEY).alias("row_key"), "text"), k)
    added = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])]
    own = {c: F.col(c) for c in added if c in docs.columns}
    columns = [c for c in docs.columns if keep_text or c != "text"]
    return unboxed(_judged(keyed, hits, k, keep_text), columns, read, *[c for c in added if c not in own], **own)


def _judged(keyed: DataFrame, hits: DataFrame, k: int, keep_text: bool) -> DataFrame:
    added = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    hits = hits.select(F.col("row_key").alias(KEY), F.col("windows").alias(HITS))
    joined = keyed.join(hits, KEY, "left").drop(KEY)
    others = ["doc_id", BOX, *(["text"] if keep_text else [])]
    schema = schema_of(joined, others, added)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, windows = batch.column("text").to_pylist(), batch.column(HITS)
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for i, text in enumerate(texts):
                words = ascii_words(text)
                n, removed = len(words), 0
                hit = windows[i]
                if hit.is_valid and n >= k:
                    known = np.sort(hit.values.to_numpy().view(U64))
                    own = window_hashes(hash_words(words), k)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    gone = covered_words(n, known[at] == own, k)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept.decode("utf-8", "surrogatepass") if removed else text)
            columns = [batch.column(c) for c in others]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            columns += [pa.array(kept_texts, pa.string())] if keep_text else []
            yield pa.record_batch(columns, names=[*others, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])])

    return joined.mapInArrow(run, schema)


def remove_repeated_windows(docs: DataFrame, k: int = 35) -> DataFrame:
    """``docs`` with repeated windows cut from ``text`` (untouched texts stay as they are)."""
    read = ("doc_id", "text")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return unboxed(judge_windows(boxed(docs, *read), k), docs.columns, read, text=text)
