"""LM scoring with a log-frequency Bloom filter.

Counts come from every training document (all but those that ``held_out``
marks).  A count c of an n-gram is quantised to level ``1 + floor(log_B c)``, and
the n-gram enters the filter once per level up to its own; a reader probes level
after level until one is missing or the highest level put in is passed.  Two
filters are built block by block on the executors (a block holds the n-grams
with the same leading hash bits, so each n-gram is counted and inserted in one
place): all unigrams and all bigrams, those seen once as well.  Their sizes
follow the levels counted, so that 1 - exp(-1 / SPARE) of the bits are set in a
corpus of any size, and an n-gram that was never put in passes a level by chance
with that to the power of PROBES (2.3 %).  Filters of up to ``BROADCAST_BITS``
together are broadcast; larger ones stay in their blocks: each chunk of texts asks the blocks for its distinct
n-grams (in order, 40 bits each) and gets their levels back in that order, one
byte each.

``score`` is the log10 probability under ``L * c(hw)/c(h) + (1 - L) * (c(w) +
1)/(N + V + 1)`` with counts read from the filters.  ``base_score`` is the exact
add-one unigram score: frequent words (a table of fixed size, broadcast) are
added up while scanning, all others meet their exact counts in a join.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, and one end token
closes each text.  Words are told apart by 64-bit hashes.  Null text: empty (the
end token alone).  Null ``doc_id`` trains.  Repeated rows count as often as they
occur.  Texts of any length are scored whole.  Without training documents N and
V are 0.  Only ``doc_id`` and ``text`` are read.  Empty table: empty result.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, ascii_words, chunked, discard, hash_words, materialize, mix64, release_shuffles, signed
from .ngram_join import runs

#: The end token; no word hashes to it but by chance.
END = np.uint64(0xE14D0E0D5EED)
#: Rows of the broadcast table of exact counts; bits of both filters up to which they are broadcast.
HEAD_ROWS, BROADCAST_BITS = 1 << 19, 7 << 27
#: Characters of text that a worker holds tokenised while it scores, counts bigrams, or asks for them.
SCORE_CHARS, BIGRAM_CHARS, ASK_CHARS = 1_500_000, 6_000_000, 3_000_000
#: Bits a probe of a level put in.
SPARE = 3
BASE, PROBES, MIX = 1.5, 3, 0.4


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class LogFrequencyFilter:
    """``blocks`` (a power of two) Bloom filters of ``width`` bits; a hash's top bits name its block."""

    def __init__(self, total_bits: int, blocks: int, top: int = 64):
        self.width = max(1024, -(-total_bits // blocks // 64) * 64)
        self.top = top
        self.blocks = blocks
        # bits that name the block; of the rest, 40 tell n-grams apart
        self.lead = int(np.log2(blocks))
        self.shift, self.rest = U64(64 - self.lead), U64(max(0, 24 - self.lead))

    def block_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.shift).astype(np.int64) if self.blocks > 1 else np.zeros(len(h), dtype=np.int64)

    def told_apart(self, h: np.ndarray) -> np.ndarray:
        """Hashes by what a question carries of them."""
        return h >> self.rest << self.rest

    def packed(self, h: np.ndarray) -> bytes:
        """40 bits of each hash of one block."""
        low = (h << U64(self.lead)) >> U64(24)
        return np.ascontiguousarray(low.reshape(-1, 1).view(np.uint8)[:, :5]).tobytes()

    def unpacked(self, data: bytes, block: int) -> np.ndarray:
        wide = np.zeros((len(data) // 5, 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
        low = wide.view(U64).ravel() << self.rest
        return low | U64(block) << self.shift if self.lead else low

    def places(self, h: np.ndarray, level: int, probe: int) -> np.ndarray:
        return (mix64(h + U64((level * PROBES + probe + 1) * 0xD1342543DE82EF95 % 2**64)) >> U64(32)) * U64(self.width) >> U64(32)

    def level(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)

    def fill(self, h: np.ndarray, counts: np.ndarray) -> bytes:
        """Bits of one block."""
        return self.fill_levels(h, self.level(counts))

    def fill_levels(self, h: np.ndarray, levels: np.ndarray) -> bytes:
        h = self.told_apart(h)
        bits = np.zeros(self.width, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = h[levels >= level]
            for probe in range(PROBES):
                bits[self.places(own, level, probe)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def read(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Counts that the levels found stand for (0 if not even the first is)."""
        return self.stand_for(self.read_levels(table, h, self.block_of(h)))

    def read_levels(self, table: np.ndarray, h: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Levels found; ``blocks`` says where in the table each hash's block is."""
        h = self.told_apart(h)
        levels = np.zeros(len(h), dtype=np.int64)
        alive = np.arange(len(h))
        level = 1
        while len(alive) and level <= self.top:
            own = h[alive]
            base = blocks[alive].astype(U64) * U64(self.width)
            found = np.ones(len(own), dtype=bool)
            for probe in range(PROBES):
                at = base + self.places(own, level, probe)
                found &= (table[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[found]
            levels[alive] = level
            level += 1
        return levels

    def stand_for(self, levels: np.ndarray) -> np.ndarray:
        low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
        return np.where(levels > 0, np.sqrt(low * np.maximum(low, np.ceil(BASE**levels - 1e-9) - 1)), 0.0)

    def counted(self, parts: DataFrame, tag: str) -> DataFrame:
        """Merge ``block, hashes, counts`` parts: a row a block with its n-grams and their levels."""

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            return h[first], np.add.reduceat(n, first) if len(h) else n

        def row(block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, n = merged(parts)
            return _block_row(block, self.packed(h), self.level(n).astype(np.uint8))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a block's parts are added up as they pass, never held all at once
            at, parts, new = None, [], 0
            for batch in batches:
                for block, hashes, counts in zip(*batch.columns):
                    if block.as_py() != at:
                        if at is not None:
                            yield row(at, parts)
                        at, parts, new = block.as_py(), [], 0
                    n = np.frombuffer(counts.as_buffer(), dtype=np.uint32).astype(np.int64)
                    parts.append((self.unpacked(hashes.as_py(), at), n))
                    new += len(n)
                    if new >= max(HELD_PARTS, len(parts[0][1])):  # no less than what is there: each entry is merged few times
                        parts, new = [merged(parts)], 0
            if at is not None:
                yield row(at, parts)

        made = parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, COUNTED)
        return materialize(made, tag)

    def counted_words(self, counts: DataFrame, tag: str) -> DataFrame:
        """The same for ``h, n`` rows with exact counts: a row a block and batch, none cut."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    h = batch.column(0).to_numpy().view(U64)
                    order = np.argsort(h)
                    h, levels = h[order], self.level(batch.column(1).to_numpy()[order]).astype(np.uint8)
                    blocks, starts = np.unique(self.block_of(h), return_index=True)
                    cuts = [*starts.tolist(), len(h)]
                    own = [[f(a, b) for a, b in zip(cuts, cuts[1:])] for f in (lambda a, b: self.packed(h[a:b]), lambda a, b: levels[a:b].tobytes())]
                    yield pa.record_batch([pa.array(blocks, pa.int64()), *[pa.array(x, pa.binary()) for x in own]], names=["block", "hashes", "levels"])

        def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (block,), t in runs(batches, 1):
                yield _block_row(block, b"".join(t.column(1).to_pylist()), np.frombuffer(b"".join(t.column(2).to_pylist()), dtype=np.uint8))

        parts = counts.mapInArrow(run, "block long, hashes binary, levels binary")
        return materialize(parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, COUNTED), tag)

    def fitted(self, counted: DataFrame) -> LogFrequencyFilter:
        """A filter with these blocks and room for the levels counted."""
        put, top = counted.agg(F.sum("put"), F.max("top")).first()
        return LogFrequencyFilter((put or 0) * PROBES * SPARE, self.blocks, top or 0)

    def filled(self, counted: DataFrame) -> DataFrame:
        """Each block's bits."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, h, levels in zip(batch.column(0), batch.column(1), batch.column(2)):
                    bits = self.fill_levels(self.unpacked(h.as_py(), block.as_py()), np.frombuffer(levels.as_buffer(), dtype=np.uint8))
                    yield pa.record_batch([pa.array([block.as_py()], pa.int64()), pa.array([bits], pa.binary())], names=["block", "bits"])

        return counted.select("block", "hashes", "levels").mapInArrow(run, "block long, bits binary")

    def gathered(self, counted: DataFrame) -> np.ndarray:
        """All blocks' bits on the driver, for filters small enough to broadcast."""
        table = np.zeros(self.bits >> 3, dtype=np.uint8)
        for block, bits in self.filled(counted).toLocalIterator():  # a bounded number of bits in all
            at = block * (self.width >> 3)
            table[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
        return table

    @property
    def bits(self) -> int:
        return self.blocks * self.width

    def parts(self, h: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """Sorted hashes and their counts, cut by block."""
        blocks = self.block_of(h)
        names, starts = np.unique(blocks, return_index=True)
        cuts = [*starts.tolist(), len(h)]
        counts = counts.astype(np.uint32)  # of one chunk
        return pa.record_batch(
            [pa.array(names), pa.array([self.packed(h[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            names=["block", "hashes", "counts"],
        )


#: N-grams of a block's parts that are held before they are added up.
HELD_PARTS = 1_000_000
PARTS = "block long, hashes binary, counts binary"
COUNTED = "block long, put long, top long, hashes binary, levels binary"


def _block_row(block: int, hashes: bytes, levels: np.ndarray) -> pa.RecordBatch:
    numbers = (block, int(levels.sum(dtype=np.int64)), int(levels.max(initial=0)))
    return pa.record_batch([*[pa.array([x], pa.int64()) for x in numbers], *[pa.array([x], pa.binary()) for x in (hashes, levels.tobytes())]], names=["block", "put", "top", "hashes", "levels"])


def _blocks(chars: float, per_bit: float) -> LogFrequencyFilter:
    """Blocks by the text's size; their bits are known once the n-grams are counted."""
    bits = 1 << max(18, int(np.ceil(np.log2(max(1.0, chars) / per_bit))))
    return LogFrequencyFilter(bits, min(1 << 24, max(16, min(4096, bits >> 17), bits >> 24)))


def token_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts in a row, and each text's first place."""
    own = [np.append(hash_words(ascii_words(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if t else None)), END) for t in texts]
    lengths = np.array([len(x) for x in own], dtype=np.int64)
    return np.concatenate(own), np.cumsum(lengths) - lengths


def bigram_hashes(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each token after the one before it (a text begins after an end)."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = END
    return mix64(before * U64(0x9E3779B97F4A7C15) + tokens)


def _scored_by_blocks(docs: DataFrame, filters: tuple, counted: tuple, scores, schema: str) -> DataFrame:
    """Scores from filters that stay in their blocks.

    Texts are cut into chunks.  Each chunk's distinct n-grams, in order, go to
    their blocks, where the bits are read; their levels come back in that order
    and meet the chunk's texts.  A row's ``kind`` is 0 and 1 for uni- and bigrams.
    """

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunked(batch.column(1).to_pylist(), ASK_CHARS):
                names = pa.array([uuid.uuid4().int >> 65] * (hi - lo), pa.int64())
                yield pa.record_batch([names, *batch.slice(lo, hi - lo).columns], names=["chunk", "doc_id", "text", "held_out"])

    chunks = materialize(docs.mapInArrow(named, "chunk long, doc_id long, text string, held_out boolean"), "chunks")

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), t in runs(batches, 1):
            tokens, starts = token_hashes(t.column(1).to_pylist())
            for kind, h in enumerate((tokens, bigram_hashes(tokens, starts))):
                h = np.unique(h)
                blocks, first = np.unique(filters[kind].block_of(h), return_index=True)
                cuts = [*first.tolist(), len(h)]
                n = len(blocks)
                yield pa.record_batch([pa.array([kind] * n, pa.int64()), pa.array(blocks, pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array([filters[kind].packed(h[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["kind", "block", "chunk", "data"])

    questions = chunks.select("chunk", "text").mapInArrow(asked, "kind long, block long, chunk long, data binary")
    bits = [f.filled(c).select(F.lit(kind).cast("long").alias("kind"), "block", F.lit(-1).cast("long").alias("chunk"), F.col("bits").alias("data")) for kind, (f, c) in enumerate(zip(filters, counted))]

    def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, None  # a block's bits come before the questions to it
        for batch in batches:
            found: list[tuple] = []
            rows = list(zip(*[batch.column(c).to_pylist() for c in range(4)]))
            for place, group in itertools.groupby(rows, lambda row: row[:2]):
                kind, block = place
                asked_for = []
                for _, _, chunk, data in group:
                    if chunk == -1:
                        at, table = place, np.frombuffer(data, dtype=np.uint8)
                    else:
                        asked_for.append((chunk, data))
                # all chunks' questions to a block in one reading
                h = filters[kind].unpacked(b"".join(data for _, data in asked_for), block)
                levels = np.zeros(len(h), dtype=np.int64)
                if at == place:  # no bits: no n-gram of this block was put in
                    levels = filters[kind].read_levels(table, h, levels)
                levels, start = levels.astype(np.uint8), 0
                for chunk, data in asked_for:
                    n = len(data) // 5
                    found.append((chunk, kind, block, levels[start : start + n].tobytes()))
                    start += n
            if found:
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "kind", "block", "levels"])

    asked_of = bits[0].unionByName(bits[1]).unionByName(questions).repartition("kind", "block").sortWithinPartitions("kind", "block", "chunk")
    answers = asked_of.mapInArrow(answered, "chunk long, kind long, block long, levels binary")

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, 1):
            kinds = t.column(1).to_numpy()
            put = [np.frombuffer(b"".join(t.column(3).filter(pa.array(kinds == kind)).to_pylist()), dtype=np.uint8) for kind in (0, 1)]

            def levels_of(*wanted: np.ndarray, put=put) -> list[np.ndarray]:
                if [len(x) for x in put] != [len(x) for x in wanted]:
                    raise ValueError("a chunk's answers do not fit its n-grams")
                return [x.astype(np.int64) for x in put]

            yield scores(t.filter(pa.array(kinds == 2)).select([4, 5, 6]).combine_chunks().to_batches()[0], levels_of)

    nothing = {"block": "long", "levels": "binary", "doc_id": "long", "text": "string", "held_out": "boolean"}
    texts = chunks.withColumn("kind", F.lit(2).cast("long"))
    both = [df.select("chunk", "kind", *[c if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()]) for df in (answers, texts)]
    return both[0].unionByName(both[1]).repartition("chunk").sortWithinPartitions("chunk", "kind", "block").mapInArrow(final, schema)


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    training = docs.where(~F.col("held_out")).select("text")
    chars = training.agg(F.sum(F.length("text"))).first()[0] or 0

    def unigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunked(texts):
                h, n = np.unique(token_hashes(texts[lo:hi])[0], return_counts=True)
                yield pa.record_batch([signed(h), pa.array(n)], names=["h", "n"])

    counts = training.mapInArrow(unigrams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "unigrams")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = total or 0, distinct or 0

    # the most frequent words whose number the table's size bounds
    levels = sorted((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect())
    least, rows = None, 0
    for level, n in reversed(levels):
        if rows + n > HEAD_ROWS:
            break
        least, rows = level, rows + n
    head = counts.where(F.lit(False)) if least is None else counts.where(F.col("n") >= 2**least)
    head = head.toArrow()
    order = np.argsort(head.column("h").to_numpy().view(U64))
    head_h, head_n = head.column("h").to_numpy().view(U64)[order], head.column("n").to_numpy()[order]

    one, two = _blocks(chars, 4), _blocks(chars, 2)
    counted1 = one.counted_words(counts, "words")

    def bigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunked(texts, BIGRAM_CHARS):
                yield two.parts(*np.unique(bigram_hashes(*token_hashes(texts[lo:hi])), return_counts=True))

    counted2 = two.counted(training.mapInArrow(bigrams, PARTS), "bigrams")
    release_shuffles(spark)
    one, two = one.fitted(counted1), two.fitted(counted2)
    denominator = float(total + distinct + 1)
    known = spark.sparkContext.broadcast((head_h, head_n))

    def scores(part: pa.RecordBatch, levels_of) -> pa.RecordBatch:
        """Rows of ``doc_id, text, held_out``, scored with the levels of some unigrams and bigrams."""
        known_h, known_n = known.value
        tokens, starts = token_hashes(part.column(1).to_pylist())
        uniq, inverse = np.unique(tokens, return_inverse=True)
        pairs, back = np.unique(bigram_hashes(tokens, starts), return_inverse=True)
        found1, found2 = levels_of(uniq, pairs)
        uni, joint = one.stand_for(found1), two.stand_for(found2)[back]
        single = uni[inverse]
        before = np.empty_like(single)
        before[1:] = single[:-1]
        before[starts] = uni[np.searchsorted(uniq, END)]
        ratio = np.minimum(1.0, joint / np.maximum(before, 1.0))
        p = MIX * ratio + (1 - MIX) * (single + 1) / denominator
        model = np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)
        at = np.minimum(np.searchsorted(known_h, uniq), max(0, len(known_h) - 1))
        frequent = known_h[at] == uniq if len(known_h) else np.zeros(len(uniq), dtype=bool)
        exact = np.where(frequent, known_n[at] if len(known_n) else 0, 0)
        own = np.where(frequent, np.log10((exact + 1) / denominator), 0.0)
        base = np.add.reduceat(own[inverse], starts)
        seen = np.add.reduceat(frequent[inverse].astype(np.int64), starts)
        lengths = np.diff([*starts, len(tokens)])
        rare = np.flatnonzero(~frequent[inverse])
        owner = np.repeat(np.arange(len(starts)), lengths)[rare]
        offsets = np.searchsorted(owner, np.arange(len(starts) + 1)).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(offsets), signed(tokens[rare]))
        return pa.record_batch([part.column(0), part.column(2), pa.array(lengths), pa.array(seen), pa.array(base), pa.array(model), others], names=["doc_id", "held_out", "n_tokens", "seen", "base", "score", "others"])

    schema = "doc_id long, held_out boolean, n_tokens long, seen long, base double, score double, others array<long>"
    if one.bits + two.bits <= BROADCAST_BITS:
        shared = spark.sparkContext.broadcast((one.gathered(counted1), two.gathered(counted2)))

        def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table1, table2 = shared.value

            def levels_of(uniq: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return one.read_levels(table1, uniq, one.block_of(uniq)), two.read_levels(table2, pairs, two.block_of(pairs))

            for batch in batches:
                for lo, hi in chunked(batch.column(1).to_pylist(), SCORE_CHARS):
                    yield scores(batch.slice(lo, hi - lo), levels_of)

        scored = docs.select("doc_id", "text", "held_out").mapInArrow(score, schema)
    else:
        scored = _scored_by_blocks(docs.select("doc_id", "text", "held_out"), (one, two), (counted1, counted2), scores, schema)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    for counted in (counted1, counted2):
        discard(counted)
    rare = scored.select("row", F.explode("others").alias("h")).join(counts, "h", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(denominator))).alias("more"), F.count("n").alias("known"))
    return scored.drop("others").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score"
    )
