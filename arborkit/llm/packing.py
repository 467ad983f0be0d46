"""Best-fit packing of tokenised documents into sequences of fixed length.

A document is its token ids (byte-level BPE, no special tokens added) followed
by id 0.  Documents longer than ``length`` are cut into pieces of ``length``
ids, of which the first takes what is over; shorter ones stay whole.

Packing is bounded-space online best fit: a fixed number of open bins, kept in a
bitset keyed by free space.  A piece goes to the bin with the least free space
that holds it; if none does, a new bin opens, and beyond ``open_bins`` the
fullest closes for good.  Pieces are dealt into groups of about ``GROUP`` by a
hash and each group is one stream, packed in one pass.  Within
a group the longest arrive first, as that order leaves fewer gaps than arrival at
random (0.04 % over the least possible number of sequences instead of 1 %), and
since a group's longer half opens a bin each, the bound closes hundreds of bins a
group.  Bins that groups leave under-filled are packed once more, group of
groups by group of groups.  Only lengths travel, never ids.

Null text: an empty document of one id.  Repeated rows are packed as often as
they occur.  Null ``doc_id`` is kept.  Among pieces of one length, the smaller
``doc_id`` arrives first.  Texts of any length are encoded whole; white-space
runs of some thousand characters go through the tokenizers library itself.  Only
``doc_id`` and ``text`` are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .ngram_join import runs

#: Pieces of a packing group, and bins open at a time.
GROUP, OPEN_BINS = 4096, 1024
#: Bins filled up to this part of their length are packed once more.
UNDER_FILLED = 7 / 8
#: Characters of white space in a row that the fast engine is trusted with.
LONGEST_BLANK = 2048


#: The vocabulary's published pre-tokeniser, but for its lookahead.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"


class ByteBpe:
    """Ids of whole texts as little-endian uint32 bytes.

    The merges of the tokenizers file run in tiktoken, which does the same far
    faster; the tokenizers library itself encodes texts with added tokens or
    with white-space runs longer than ``LONGEST_BLANK`` (the other engine's
    pattern search gives up on some hundred thousand), and the first text of
    every batch as a check (a difference hands the whole batch to it).
    ``by_library`` counts the texts it encoded for any of these reasons.  Where
    no white space touches white space or an end, the pre-tokeniser's lookahead
    never matters and the plain pattern is used.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        # printable stand-ins of bytes: bytes that print stand for themselves
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in word): i for word, i in told["model"]["vocab"].items() if word not in self.added}
        self.plain = tiktoken.Encoding("plain", pat_str=WORDS + r"|\s+", mergeable_ranks=ranks, special_tokens={})
        self.full = tiktoken.Encoding("full", pat_str=WORDS + r"|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.other_space = re.compile(r"[^\S \n]")
        self.long_blank = re.compile(r"\s{%d}" % LONGEST_BLANK)
        self.by_library = 0

    def _simple(self, text: str) -> bool:
        """White space is single spaces and line feeds between other characters."""
        return not (text[:1] in " \n" or text[-1:] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.other_space.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            simple = self._simple(text)
            if any(t in text for t in self.added) or not simple and self.long_blank.search(text):
                self.by_library += 1
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            elif simple:
                ids = self.plain.encode_ordinary(text)
            else:
                ids = self.full.encode_ordinary(text)
            out.append(array("I", ids).tobytes())
        self.by_library += bool(texts)
        if texts and self.tokenizer.encode(texts[0], add_special_tokens=False).ids != array("I", out[0]).tolist():
            self.by_library += len(texts)
            out = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return out


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, with_ids: bool = False, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = ([], [], [], [], [], [])
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                    view = memoryview(ids + end)
                    total = len(view) // 4
                    at = [0, *range((total - 1) % length + 1, total, length), total]
                    for piece, (a, b) in enumerate(zip(at, at[1:])):
                        data = view[4 * a : 4 * b]
                        for column, value in zip(rows, (doc, piece, a, b - a, zlib.crc32(data), bytes(data) if with_ids else None)):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                keep = 6 if with_ids else 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(rows[:keep], types)], names=list(names[:keep]))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(lengths: list[int], length: int, open_bins: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every item in turn, and the bins' final loads."""
    free_bits = 0  # bit f is set while an open bin has f free
    by_free: dict[int, list[int]] = {}
    opened = 0
    loads: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        fits = free_bits >> n
        if fits:
            free = ((fits & -fits).bit_length() - 1) + n
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                free_bits ^= 1 << free
            opened -= 1
        else:
            b, free = len(loads), length
            loads.append(0)
        bins.append(b)
        offsets.append(loads[b])
        loads[b] += n
        free -= n
        if free:
            if opened == open_bins:  # the fullest closes
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                opened -= 1
            by_free.setdefault(free, []).append(b)
            free_bits |= 1 << free
            opened += 1
    return bins, offsets, loads


def _pack_groups(items: DataFrame, length: int, open_bins: int) -> DataFrame:
    """``item, size, grp`` packed within ``grp``: ``item, grp, bin, place, load``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp,), t in runs(batches, 1):
            bins, offsets, loads = best_fit(t.column(2).to_pylist(), length, open_bins)
            bins = np.array(bins, dtype=np.int64)
            yield pa.record_batch(
                [pa.array(np.full(t.num_rows, grp)), t.column(1).combine_chunks(), pa.array(bins), pa.array(np.array(offsets, dtype=np.int64)), pa.array(np.array(loads, dtype=np.int64)[bins])],
                names=["grp", "item", "bin", "place", "load"],
            )

    rows = items.select("grp", "item", "size").repartition("grp").sortWithinPartitions("grp", F.col("size").desc(), "item")
    return rows.mapInArrow(run, "grp long, item long, bin long, place long, load long")


def pack(pieces: DataFrame, length: int = 2048, group: int = GROUP, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (from :func:`token_pieces`)."""
    pieces = materialize(pieces, "pieces")
    count = pieces.count()
    groups = max(1, -(-count // group))
    columns = pieces.columns
    # rows that are alike in every column still spread over the groups
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*columns, "sequence", "offset", "load"]
        for (grp,), t in runs(batches, 1):
            bins, offsets, loads = best_fit(t.column("length").to_pylist(), length, open_bins)
            bins = np.array(bins, dtype=np.int64)
            filled = np.array(loads, dtype=np.int64)[bins] if len(bins) else bins
            out = [t.column(c).combine_chunks() for c in columns]
            out += [pa.array(bins + (grp << 32)), pa.array(np.array(offsets, dtype=np.int64)), pa.array(filled)]
            yield pa.record_batch(out, names=names)

    order = dealt.select("grp", *columns).repartition("grp").sortWithinPartitions("grp", F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = materialize(order.mapInArrow(number, kinds + ", sequence long, offset long, load long"), "placed")
    # bins with room to spare, packed once more as single items
    discard(pieces)
    spare = placed.where(F.col("load") <= int(length * UNDER_FILLED)).groupBy("sequence").agg(F.max("load").alias("size"))
    spare = spare.select(F.col("sequence").alias("item"), "size", F.pmod(F.xxhash64("sequence"), F.lit(max(1, -(-groups // 256)))).alias("grp"))
    again = _pack_groups(spare, length, open_bins).select(F.col("item").alias("sequence"), ((F.col("grp") + groups) * F.lit(1 << 32) + F.col("bin")).alias("other"), F.col("place").alias("shift"))
    joined = placed.join(again, "sequence", "left")
    return joined.select(*columns, F.coalesce("other", "sequence").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: one row per piece with its place."""
    return pack(token_pieces(docs, tokenizer, length, with_ids), length)
