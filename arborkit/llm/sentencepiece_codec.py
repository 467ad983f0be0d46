"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding is a score-ordered agenda of adjacent symbol pairs: the pair whose
joined piece scores highest merges first (ties: leftmost), until no neighbouring
pair forms a piece; symbols outside the vocabulary fall back to bytes.  A space
is written as U+2581, and one stands before the text.  Where no piece of the
vocabulary holds U+2581 after another character (checked when the model loads),
merges never cross the place before a run of spaces, so each distinct
space-led part is encoded once and remembered.

In every Arrow batch all newly met parts, and the batch's first text whole
(encoding and decoding), are checked against the sentencepiece library; a batch
in which the two differ takes the library's ids.  Texts of any script take the
agenda; only those that the model's normaliser rewrites, or that hold U+2581 or
U+0000 themselves, go to the library whole (``by_library`` counts them).

Null text: as empty (no ids).  Repeated rows: encoded alike.  Texts and unbroken
words of any length are encoded whole.  Only ``doc_id`` and ``text`` are read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BARE, PartCache, spaced_parts

SPACE = "▁"
NEVER = float("inf")
SPACED = re.compile("( +)([^ \n]*)|(?=[^ ])(\n|[^ \n]+)")


def written(part: str) -> str:
    """A part as the model sees it, with U+2581 for the space before it."""
    return part[1:] if part[0] == BARE else part if part[0] in "\n" + SPACE else SPACE + part


class MergeCodec:
    """Encoder and decoder around one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i)}
        self.ids = {names[i]: i for i in range(n) if i not in special}
        self.cost = {names[i]: -self.library.get_score(i) for i in range(n) if i not in special}.get
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if self.library.is_byte(i)}
        self.raw = [bytes([int(x[1:-1], 16)]) if self.library.is_byte(i) else b"" if self.library.is_control(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.separable = len(self.bytes) == 256 and not any(SPACE in x.lstrip(SPACE) or "\n" in x for x in self.ids)
        self.parts = PartCache(self.learn)
        self.new: list[str] = []
        # neighbours that no piece holds side by side never merge
        self.pairs = {x[i : i + 2] for x in self.ids for i in range(len(x) - 1)}
        self.differ = self.by_library = 0
        # common characters that normalisation leaves alone, found by asking the library; texts
        # with others are normalised whole to see whether they stay as they are
        probe = [chr(c) for c in (*range(0x20, 0x250), *range(0x370, 0x530), *range(0x2010, 0x2030))] + ["\n", "\t", "\r"]
        plain = [c for c in probe if self.library.normalize(f"a{c}b") == f"{SPACE}a{c if c != ' ' else SPACE}b"]
        spaces = self.library.normalize(" a  b ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}"
        self.odd = re.compile("[^" + "".join(map(re.escape, plain)) + "]")
        self.whole = not (spaces and self.separable)

    # ---- the agenda
    def merge(self, text: str) -> list[int]:
        """Ids of a text whose spaces are already U+2581."""
        symbols = self._merge_few(list(text)) if len(text) <= 40 else self._merge_many(text)
        out, ids = [], self.ids
        for symbol in symbols:
            found = ids.get(symbol)
            if found is None:
                out.extend([self.bytes[b] for b in symbol.encode()])
            else:
                out.append(found)
        return out

    def _merge_few(self, symbols: list[str]) -> list[str]:
        """The agenda as a list in symbol order, its best taken by a scan."""
        cost, never = self.cost, NEVER
        agenda = [cost(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            joined = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + joined, never)
            if i < len(agenda):
                agenda[i] = cost(joined + symbols[i + 1], never)
        return symbols

    def _merge_many(self, text: str) -> list[str]:
        """The agenda as a heap, for long runs without a boundary."""
        cost = self.cost
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or after[i] != j or len(left) + len(right) != size:
                continue  # one side has merged meanwhile
            symbols[i], symbols[j] = left + right, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (c := cost(symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, (c, a, b, len(symbols[a]) + len(symbols[b])))
        return [x for x in symbols if x]

    def learn(self, part: str) -> bytes:
        """Comma-joined ids of a new part; a closing mark that cannot merge is cut off."""
        if len(part) > 1 and part[-1] in ".,!?%;:" and part[-2:] not in self.pairs:
            return self.parts[part[:-1]] + b"," + self.parts[BARE + part[-1]] if part[-2] != BARE else self._learn(part)
        return self._learn(part)

    def _learn(self, part: str) -> bytes:
        self.new.append(part)
        return ",".join(map(str, self.merge(written(part)))).encode()

    def checked(self) -> bool:
        """Compare the parts learnt since the last call with the library, in one call."""
        parts, self.new = self.new, []
        texts = [written(p) for p in parts]
        # a lone U+2581 or a part without one is checked behind a line feed
        behind = [not (w[0] == SPACE and w != SPACE) for w in texts]
        theirs = self.library.encode(["\n" + w.replace(SPACE, " ") if b else w[1:].replace(SPACE, " ") for w, b in zip(texts, behind)], num_threads=1) if parts else []
        lead = len(self.library.encode("\n"))
        before = self.differ
        for part, ids, b in zip(parts, theirs, behind):
            ids = ",".join(map(str, ids[lead:] if b else ids)).encode()
            if self.parts[part] != ids:
                self.differ += 1
        return self.differ == before

    def split(self, text: str) -> list[str]:
        """Parts that no merge crosses; runs of spaces stay with what follows."""
        if not (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text):
            parts = spaced_parts(text)
            parts[0] = parts[0][1:]  # the space that stands before a text
            return parts
        out = []
        for lead, word in ((a, b or c) for a, b, c in SPACED.findall(" " + text)):
            out.append(SPACE * len(lead) + word if lead else word if word == "\n" else BARE + word)
        return out

    def rewritten(self, text: str) -> bool:
        """Whether a text with uncommon characters reaches the model as another."""
        return SPACE in text or BARE in text or self.library.normalize(text) != SPACE + text.replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Comma-joined decimal ids of every text."""
        known = self.parts.__getitem__
        out = []
        for text in texts:
            if self.whole or self.odd.search(text) and self.rewritten(text):
                self.by_library += 1
                out.append(",".join(map(str, self.library.encode(text))).encode())
            else:
                out.append(b",".join(map(known, self.split(text))) if text else b"")
        if not self.checked():  # never seen; the library's word stands
            self.by_library += len(texts)
            self.parts.clear(), self.parts.before.clear()
            out = [",".join(map(str, ids)).encode() for ids in self.library.encode(texts, num_threads=1)]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces rejoined, the leading space dropped."""
        raw = self.raw
        data = b"".join(map(raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_CODECS: dict[str, MergeCodec] = {}


def codec(path: str) -> MergeCodec:
    if path not in _CODECS:
        _CODECS[path] = MergeCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (``ids, decoded``) per row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                encoded = c.encode(texts)
                ids = [np.fromstring(x, dtype=np.int32, sep=",").tolist() for x in encoded]
                decoded = [c.decode(x) for x in ids]
                if c.library.encode(texts[0]) != ids[0] or c.library.decode(ids[0]) != decoded[0]:
                    ids = c.library.encode(texts, num_threads=1)
                    encoded = [",".join(map(str, x)).encode() for x in ids]
                    decoded = [c.library.decode(x) for x in ids]
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64())]
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in encoded]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
