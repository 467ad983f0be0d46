"""Phrase collocation mining over position bitmaps.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those
into words ``[^\\x20\\x09]+``.  Everything is counted by language (null: ``und``):
``f(phrase)`` is the number of its contiguous occurrences within pieces, overlaps
included, and ``n`` that of all words.  Candidates are phrases of two to ``longest``
words with ``a = f(phrase) >= least``.  Cut after its first k words, a candidate
scores ``floor(1000 a n / (l r))`` with the counts of both parts; the lowest-scoring
cut counts (ties: smallest k).  Candidates that lie in a longer one which occurs at
least ``percent`` per cent as often are dropped.  The best ``top`` of each language
stay: by score, then ``a`` (both descending), then phrase (bytes, ascending).

How it runs: texts are cut into shards, one language each, of a bounded number of
words, which are numbered and written once.  A shard's word places are counted on (a
piece's end takes one too); each word keeps the 64-place blocks in which it occurs and
their bits.  A phrase's bitmap marks the places of its last word; shifted by one place
and ANDed with a word's bitmap it is that of the longer phrase, and its popcount is
added up over shards.  Depth-first, some first words at a time, phrases are extended
as long as what is known of the whole corpus lets them reach ``least``:

1. words: counts of all;
2. pairs of words that both occur often enough: their popcounts go into a count-min
   sketch, which never falls short, and those whose sketched count reaches ``least``
   are counted exactly;
3. phrases of three to ``longest`` words of which every adjacent pair does: likewise,
   exactly where the sketched count of each beginning reaches ``least``, too.

What occurs often enough reaches the tasks as a filter of bits of bounded size; past
that size it lets more through to the exact sums, and never loses a phrase.  Scores are
computed in decimals of 38 digits.

Null or empty text: no words.  Texts of any length are read whole, in parts that
end with a piece.  Repeated rows count again.  Other columns are not read.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, RepeatSketch, discard, hash_words, materialize, mix64, pack_ascending, slices, unpack_ascending

#: Word places of a shard, block entries whose phrases are extended together, bytes of text split at once.
SHARD, ROOTS, PART = 2_000_000, 250_000, 4_000_000
#: log2 of the filters' counters a row at most: two rows' bitmaps take 34 MB (sketch: 67 MB).
FILTER_BITS, SKETCH_BITS = 27, 28
END = b"\xff"  # in no UTF-8 text
_TABLE = bytes(ord("\n") if c in b".,;:!?\x0a\x0b\x0c\x0d" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_PAIR = U64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text and an END after each piece, in lists of bounded length."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE) if text else b""
    start = 0
    while start < len(data):
        cut = data.find(b"\n", start + PART)
        end = len(data) if cut < 0 else cut + 1
        yield (data[start:end].replace(b"\n", b" \xff ") + b" \xff").split()
        start = end


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Shard:
    """Texts of one language as numbered words; END is number 0."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers({END: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words)

    def packed(self) -> tuple[bytes, bytes]:
        """Words in order of their numbers, and numbers in order of places, compressed."""
        put = zstandard.ZstdCompressor(level=1).compress
        return put(b" ".join(list(self.numbers)[1:])), put(np.concatenate(self.parts).tobytes())

    @classmethod
    def opened(cls, words: bytes, ids: bytes) -> Shard:
        get = zstandard.ZstdDecompressor().decompress
        shard = cls()
        shard.words, shard.ids = [END, *get(words).split(b" ")], np.frombuffer(get(ids), dtype=np.int32)
        return shard

    def text(self) -> pa.Array:
        return pa.array([b"", *self.words[1:]], pa.binary()).cast(pa.string())

    def hashes(self, lang: str) -> np.ndarray:
        """One hash a word, of the word and the language."""
        return mix64(hash_words(self.words) ^ hash_words([lang.encode()]))


def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """Rows ``(lang, text)`` in shards; at most twice a shard's places are held."""
    open_: dict[str, Shard] = {}
    held = 0
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for words in tokens(text.as_py()):
                shard = open_.setdefault(lang, Shard())
                shard.add(words)
                held += len(words)
                if shard.size >= SHARD or held >= 2 * SHARD:
                    full = max(open_, key=lambda x: open_[x].size)
                    held -= open_[full].size
                    yield full, open_.pop(full)
    for lang in list(open_):
        yield lang, open_.pop(lang)


def written_shards(docs: DataFrame) -> DataFrame:
    """All texts as a table of packed shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches):
            words, ids = shard.packed()
            yield pa.record_batch([pa.array([lang], pa.string()), pa.array([words], pa.binary()), pa.array([ids], pa.binary())], names=["lang", "words", "ids"])

    return materialize(docs.mapInArrow(run, "lang string, words binary, ids binary"), "phrase-shards")


def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    for batch in batches:
        for lang, words, ids in zip(*batch.columns):
            yield lang.as_py(), Shard.opened(words.as_py(), ids.as_py())


class Bitmaps:
    """Compressed position bitmaps of the words of a shard for which ``kept`` is true.

    ``entry_bits`` holds the non-empty 64-place blocks of every word, word by word;
    ``entry_of`` leads from a place to the block of the word that stands there.
    """

    def __init__(self, ids: np.ndarray, kept: np.ndarray):
        kept = kept.copy()
        kept[0] = False
        place = np.flatnonzero(kept[ids])
        place = place[np.argsort(ids[place], kind="stable")]
        word, block = ids[place], place >> 6
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])]) if len(place) else np.zeros(0, np.int64)
        self.word, self.block = word[first], block[first]
        ones = U64(1) << (place & 63).astype(U64)
        self.bits = np.bitwise_or.reduceat(ones, first) if len(place) else np.zeros(0, U64)
        self.entry_of = np.full((len(ids) // 64 + 2) * 64, -1, dtype=np.int32)
        self.entry_of[place] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff([*first, len(place)]))

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(phrase, entry, bits)``: phrase bitmaps shifted by a place, ANDed with those of all words that they meet."""
        over = np.flatnonzero(bits >> U64(63))
        phrase, block = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1])
        bits = np.concatenate([bits << U64(1), np.ones(len(over), dtype=U64)])
        found = []
        while True:
            left = np.flatnonzero(bits)
            if not len(left):
                break
            phrase, block, bits = phrase[left], block[left], bits[left]
            lowest = bits & (~bits + U64(1))
            entry = self.entry_of[(block << 6) + np.bitwise_count(lowest - U64(1))]
            met = np.where(entry >= 0, bits & self.bits[np.maximum(entry, 0)], lowest) if len(self.bits) else lowest
            own = np.flatnonzero(entry >= 0)
            found.append((phrase[own], entry[own], met[own]))
            bits = bits & ~met
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, U64)
        return tuple(np.concatenate(c) for c in zip(*found))


def mined(shard: Shard, own: np.ndarray, kept: np.ndarray, lengths: range, may=None, named: bool = True) -> Iterator[tuple[np.ndarray, pa.Array | None, np.ndarray]]:
    """Keys, phrases (if ``named``) and counts in a shard, for every length of ``lengths``, depth-first.

    ``own`` has a hash and ``kept`` a mark for each word.  ``may(length, last, new,
    keys)`` says which phrases stay: by the numbers of their last two words and by key.
    """
    maps = Bitmaps(shard.ids, kept)
    text = shard.text() if named else None
    # first words in lots of about ROOTS entries; a word's entries stay together
    starts = np.flatnonzero(np.r_[True, maps.word[1:] != maps.word[:-1]]) if len(maps.word) else np.zeros(0, np.int64)
    lot = starts // ROOTS
    lots = starts[np.flatnonzero(np.r_[True, lot[1:] != lot[:-1]])] if len(starts) else starts
    for lo, hi in zip(lots, [*lots[1:], len(maps.word)]):
        first_words = maps.word[lo:hi]
        words = first_words[np.r_[True, first_words[1:] != first_words[:-1]]]
        phrase, block, bits = np.cumsum(np.r_[0, first_words[1:] != first_words[:-1]]), maps.block[lo:hi], maps.bits[lo:hi]
        names, keys = text.take(pa.array(words)) if named else None, own[words]
        for length in range(2, lengths.stop):
            phrase, entry, bits = maps.extended(phrase, block, bits)
            if not len(phrase):
                break
            grown = phrase * len(shard.words) + maps.word[entry]
            order = np.argsort(grown, kind="stable")
            grown, entry, bits = grown[order], entry[order], bits[order]
            new = np.r_[True, grown[1:] != grown[:-1]]
            first = np.flatnonzero(new)
            before, after = np.divmod(grown[first], len(shard.words))
            times = np.add.reduceat(np.bitwise_count(bits), first, dtype=np.int64)
            phrase, keys = np.cumsum(new) - 1, _pair_keys(keys[before], own[after])
            if may is not None:
                ok = may(length, words[before], after, keys)
                before, after, times, keys = before[ok], after[ok], times[ok], keys[ok]
                stays = ok[phrase]
                phrase, entry, bits = (np.cumsum(ok) - 1)[phrase[stays]], entry[stays], bits[stays]
            if not len(before):
                break
            block, words = maps.block[entry], after
            if named:
                names = pc.binary_join_element_wise(names.take(pa.array(before)), text.take(pa.array(after)), " ")
            if length in lengths:
                yield keys, names, times


# --------------------------------------------------------------------------- filters
def _pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix64(before * _PAIR + after)


def frequent(found: DataFrame, size: int):
    """Broadcast filter of the frequent words (``size`` 1) or pairs (2) in ``found(lang, phrase)``."""
    sketch = RepeatSketch.for_items(found.count(), max_bits=FILTER_BITS)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            langs = hash_words([x.encode() for x in batch.column(0).to_pylist()])
            each = [mix64(hash_words([p[i] for p in parts]) ^ langs) for i in range(size)]
            own = each[0] if size == 1 else _pair_keys(*each)
            yield sketch.emit(np.repeat(own, 2))  # twice: a counter of two is a bit set

    table = sketch.merge(found.select("lang", "phrase").mapInArrow(keys, "block long, part binary"))
    return sketch, found.sparkSession.sparkContext.broadcast(table)


class CountSketch(RepeatSketch):
    """Count-min sketch of counted keys; counters stop at ``least``, and the bitmap tells which got there.

    ``mass`` is the sum of all counts at most: a thirty-second of ``least`` falls on
    a counter, up to the largest size.  With so little noise one row is enough.
    """

    depth = 1

    def __init__(self, mass: float, least: int):
        super().__init__(min(SKETCH_BITS, int(np.ceil(np.log2(max(2.0, 32 * mass / least))))))
        self.least = least

    def emit_counts(self, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        names, payloads = [], []
        for row in range(self.depth):
            touched, at = np.unique(self.slots(keys, row), return_inverse=True)
            counts = np.minimum(np.bincount(at, weights=times, minlength=len(touched)), self.least).astype(np.uint32)
            blocks, starts = np.unique(touched >> self.block_bits, return_index=True)
            offsets = (touched & ((1 << self.block_bits) - 1)).astype(np.uint32)
            for name, lo, hi in zip(blocks, starts, [*starts[1:], len(touched)]):
                wide = np.uint8 if counts[lo:hi].max() < 256 else np.uint32
                head = np.array([hi - lo, np.dtype(wide).itemsize], dtype=np.uint32).tobytes()
                names.append(row << 32 | int(name))
                payloads.append(head + counts[lo:hi].astype(wide).tobytes() + pack_ascending(offsets[lo:hi]))
        return pa.record_batch([pa.array(names, pa.int64()), pa.array(payloads, pa.binary())], names=["block", "part"])

    def merge(self, parts: DataFrame) -> np.ndarray:
        width = 1 << self.block_bits

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, counts = None, np.zeros(width, dtype=np.uint32)

            def out():
                return pa.record_batch([pa.array([current], pa.int64()), pa.array([np.packbits(counts >= self.least, bitorder="little").tobytes()], pa.binary())], names=["block", "part"])

            for batch in batches:
                for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if block != current:
                        if current is not None:
                            yield out()
                        current, counts = block, np.zeros(width, dtype=np.uint32)
                    data = part.as_buffer()
                    n, size = np.frombuffer(data, dtype=np.uint32, count=2)
                    own = np.frombuffer(data, dtype=np.uint8 if size == 1 else np.uint32, offset=8, count=n)
                    at = unpack_ascending(data.slice(8 + int(n) * int(size)))
                    counts[at] = np.minimum(counts[at] + own, self.least)
            if current is not None:
                yield out()

        merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, part binary")
        table = np.zeros((self.depth, 1 << (self.bits - 3)), dtype=np.uint8)
        for block, part in merged.collect():  # size fixed by bits
            lo = (block & 0xFFFFFFFF) << (self.block_bits - 3)
            table[block >> 32, lo : lo + (width >> 3)] = np.frombuffer(part, dtype=np.uint8)
        return table


# ------------------------------------------------------------------------- the mining
COUNTED = "lang string, phrase string, times long"
#: Counted phrases that a task holds to add them up.
HELD = 500_000


def _counted(lang: str, names: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([lang] * len(names), pa.string()), names, pa.array(times, pa.int64())], names=["lang", "phrase", "times"])


def _sums(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by(["lang", "block", "phrase"]).aggregate([("times", "sum")]).rename_columns(["lang", "block", "phrase", "times"])


def _packed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """A row for each language and block of phrases: its phrases, one a line, and their counts."""
    whole = _sums(held).sort_by([("lang", "ascending"), ("block", "ascending")])
    lang, block = whole.column("lang").combine_chunks().dictionary_encode(), whole.column("block").to_numpy()
    code = lang.indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])]) if len(block) else np.zeros(0, np.int64)
    phrases, times = whole.column("phrase").to_pylist(), whole.column("times").to_numpy()
    cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(block)]))
    names = ["block", "lang", "phrases", "times"]
    for lo in range(0, len(cuts), 1000):
        own = cuts[lo : lo + 1000]
        columns = ([int(block[a]) for a, _ in own], [lang.dictionary[int(code[a])].as_py() for a, _ in own], ["\n".join(phrases[a:b]).encode() for a, b in own], [times[a:b].astype(np.int64).tobytes() for a, b in own])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=names)


def _added_up(parts: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, f`` of phrases that reach ``least``; a block's parts are added up as they pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows, sum_rows = None, [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            found = _sums(held)
            found = found.filter(pc.greater_equal(found.column("times"), least))
            yield from found.select(["lang", "phrase", "times"]).rename_columns(["lang", "phrase", "f"]).to_batches(50_000)

        for batch in batches:
            for block, lang, phrases, times in zip(*batch.columns):
                if (block.as_py(), lang.as_py()) != at:
                    if at is not None:
                        yield from out()
                    at, held, rows, sum_rows = (block.as_py(), lang.as_py()), [], 0, 0
                names = pa.array(phrases.as_py().decode().split("\n"), pa.string())
                held.append(pa.table({"lang": pa.array([at[1]] * len(names), pa.string()), "block": pa.array([at[0]] * len(names), pa.int64()), "phrase": names, "times": pa.array(np.frombuffer(times.as_py(), dtype=np.int64))}))
                rows += len(names)
                if rows >= max(HELD, 2 * sum_rows):
                    held = [_sums(held)]
                    rows = sum_rows = held[0].num_rows
        if at is not None:
            yield from out()

    return parts.repartition("block", "lang").sortWithinPartitions("block", "lang").mapInArrow(run, "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all phrases (words, too) with ``f >= least``, and ``lang, n``."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    cut = written_shards(docs)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in opened(batches):
            times = np.bincount(shard.ids, minlength=len(shard.words))
            # the END stands for the language: its row counts all words
            times[0] = len(shard.ids) - times[0]
            names = pa.concat_arrays([pa.array([None], pa.string()), shard.text().slice(1)])
            yield _counted(lang, names, times)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang", "phrase").agg(F.sum("times").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())

    words = materialize(summed(cut.mapInArrow(count, COUNTED)), "word-counts")
    totals, words = words.where("phrase is null").select("lang", F.col("f").alias("n")), words.where("phrase is not null")
    words_sketch, often = frequent(words, 1)

    def sketched(sketch: CountSketch, lengths: range, may) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, shard in opened(batches):
                own = shard.hashes(lang)
                found = [(keys, times) for keys, _, times in mined(shard, own, words_sketch.repeated(often.value, own), lengths, may(own), named=False)]
                if found:
                    yield sketch.emit_counts(*(np.concatenate(c) for c in zip(*found)))

        return cut.sparkSession.sparkContext.broadcast(sketch.merge(cut.mapInArrow(run, "block long, part binary")))

    def exact(lengths: range, may, mass: float) -> DataFrame:
        # some 20,000 phrases a block, by the most that can reach least
        blocks = 1 << min(20, max(4, int(np.ceil(np.log2(max(1.0, mass / least / 20_000))))))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            for lang, shard in opened(batches):
                own = shard.hashes(lang)
                for keys, names, times in mined(shard, own, words_sketch.repeated(often.value, own), lengths, may(own)):
                    held.append(pa.table({"lang": pa.array([lang] * len(times), pa.string()), "phrase": names, "times": pa.array(times), "block": pa.array((keys % U64(blocks)).astype(np.int64))}))
                    rows += len(times)
                if rows >= HELD:  # shards of a task are added up as far as they fit
                    yield from _packed(held)
                    held, rows = [], 0
            if held:
                yield from _packed(held)

        parts = cut.mapInArrow(run, "block long, lang string, phrases binary, times binary")
        return materialize(_added_up(parts, least), f"phrases-{lengths.start}")

    # a pair has a first word, and a longer phrase a first pair, that occurs as often
    mass = words.agg(F.sum("f")).first()[0] or 0
    pair_sketch = CountSketch(mass, least)
    likely_two = sketched(pair_sketch, range(2, 3), lambda own: None)
    two = exact(range(2, 3), lambda own: lambda length, last, new, keys: pair_sketch.repeated(likely_two.value, keys), mass)
    if longest < 3:
        discard(cut)
        return words.unionByName(two), totals
    two_sketch, often_two = frequent(two, 2)

    def adjacent(own: np.ndarray):
        return lambda length, last, new, keys: two_sketch.repeated(often_two.value, keys if length == 2 else _pair_keys(own[last], own[new]))

    mass = (longest - 2) * (two.agg(F.sum("f")).first()[0] or 0)
    long_sketch = CountSketch(mass, least)
    likely = sketched(long_sketch, range(3, longest + 1), adjacent)

    def beginning(own: np.ndarray):
        paired = adjacent(own)

        def may(length, last, new, keys):
            ok = paired(length, last, new, keys)
            if length > 2:
                ok[ok] = long_sketch.repeated(likely.value, keys[ok])
            return ok

        return may

    more = exact(range(3, longest + 1), beginning, mass)
    discard(cut)
    return words.unionByName(two).unionByName(more), totals


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of ``docs(lang, text)``."""
    found, totals = phrase_counts(docs, least, longest)
    words = F.split("phrase", " ", -1)
    wanted = found.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))

    # phrases inside longer candidates, with the most frequent of those
    sizes = F.sequence(F.lit(2), F.size("w") - 1)
    inner = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.size("w") - s + 1), lambda i: _joined(F.col("w"), i, s))))
    inside = wanted.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    inside = materialize(inside, "phrases-inside")
    free = wanted.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")

    cuts = free.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), 1, F.col("k")).alias("first"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(19,0)").alias(c) for c in "alrn"}
    cuts = cuts.withColumns({f"{c}_": exact[c] for c in "alrn"}).withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * (a_ * n_)) div (l_ * r_)"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
