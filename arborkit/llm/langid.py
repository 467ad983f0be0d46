"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the 3- to 5-byte grams of its words, each word between
``<`` and ``>`` (letters lower-cased, ASCII that is no letter as separators), over
the whole text.  Their embeddings are averaged and a softmax layer chooses the
language; both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (``MAX_LABELLED``, lowest id hashes).  A temperature is
fitted on a fifth of the sample that SGD never sees, and ``rejected`` marks
predictions whose calibrated probability lies below ``REJECT``.

As both layers are linear, a trained model is one score per subword and
language; words are scored once per chunk of texts and added up.

``und`` with score 0 where text is null or has no letter, or where nothing could
be learnt.  Only text and non-null languages of rows that are not held out are
learnt from; rows without a ``doc_id`` are predicted, not sampled.  Of rows that
share an id only one is sampled (the least by language and subwords), so the
bound holds for rows as well.  Equal texts are predicted alike; of languages with
equal probability the first by name is taken.  Texts of any length are read
whole.  Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunked, mix64, slices
from .lm_score import held_out

MAX_LABELLED, BUCKET_BITS, DIMENSIONS, GRAMS = 3000, 15, 16, (3, 4, 5)
EPOCHS, RATE, REJECT = 6, 0.5, 0.5
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword, and the number of its word."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(U64)
    owner = np.repeat(np.arange(len(words)), np.array([len(w) + 2 for w in words]))
    buckets, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, dtype=U64)
        for j in range(n):
            h = h * U64(0x100000001B3) + data[j : len(data) - n + 1 + j]
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((mix64(h[inside]) >> U64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # (buckets, languages): embeddings times output weights
    bias: np.ndarray
    temperature: float

    def probabilities(self, mean_scores: np.ndarray) -> np.ndarray:
        z = (mean_scores + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str]) -> LanguageModel:
    """``rows``: buckets and their counts of each text."""
    random = np.random.default_rng(7)
    k = len(languages)
    emb = random.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((k, DIMENSIONS), dtype=np.float32), np.zeros(k, dtype=np.float32)
    order = random.permutation(len(rows))
    kept, aside = order[len(rows) // 5 :], order[: len(rows) // 5]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(kept):
            ids, share = rows[i]
            if not len(ids):
                continue
            mean = share @ emb[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            emb[ids] -= (rate * len(ids)) * np.minimum(share, 4 / len(ids))[:, None] * back
    model = LanguageModel(languages, (emb @ out.T).astype(np.float32), bias.astype(np.float64), 1.0)
    check = [i for i in (aside if len(aside) else kept) if len(rows[i][0])]
    if check:
        means = np.stack([rows[i][1] @ model.scores[rows[i][0]] for i in check])
        best = (np.inf, 1.0)
        for t in np.geomspace(0.1, 20, 48):
            model.temperature = float(t)
            p = model.probabilities(means)[np.arange(len(check)), y[check]]
            best = min(best, (float(-np.log(np.maximum(p, 1e-9)).mean()), float(t)))
        model.temperature = best[1]
    return model


def train(docs: DataFrame, modulus: int, remainder: int) -> LanguageModel | None:
    rows = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"), modulus, remainder))
    # ids first, so that only the sample's texts travel
    chosen = rows.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = rows.join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(subwords(words_of(x))[0], return_counts=True) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(2), batch.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([b.astype(np.int32).tobytes() for _, b in found], pa.binary())], names=["doc_id", "lang", "ids", "counts"])

    got = rows.select("lang", "text", "doc_id").mapInArrow(run, "doc_id long, lang string, ids binary, counts binary")
    # one row an id: at most MAX_LABELLED reach the driver
    got = got.groupBy("doc_id").agg(F.min(F.struct("lang", "ids", "counts")).alias("s")).select("s.*").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("ids", "ascending"), ("counts", "ascending"), ("lang", "ascending")])
    languages = sorted(set(got.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    sample = []
    for a, b in zip(got.column("ids").to_pylist(), got.column("counts").to_pylist()):
        n = np.frombuffer(b, dtype=np.int32).astype(np.float32)
        sample.append((np.frombuffer(a, dtype=np.int32), n / max(1.0, n.sum())))
    return fit(sample, np.array([number[x] for x in got.column("lang").to_pylist()]), languages)


def predict_language(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, modulus, remainder))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for lo, hi in chunked(texts):
                part = texts[lo:hi]
                names, score = ["und"] * len(part), np.zeros(len(part))
                numbers: dict[bytes, int] = {}
                index = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_of(x)), dtype=np.int64) for x in part]
                if model and numbers:
                    buckets, owner = subwords(list(numbers))
                    k = len(model.languages)
                    table = np.stack([np.bincount(owner, weights=model.scores[buckets, j], minlength=len(numbers)) for j in range(k)] + [np.bincount(owner, minlength=len(numbers))], axis=1)
                    sums = np.stack([table[x].sum(axis=0) for x in index])
                    p = model.probabilities(sums[:, :k] / np.maximum(sums[:, k:], 1))
                    best = p.argmax(axis=1)
                    for i, x in enumerate(part):
                        if has_letter(x):
                            names[i], score[i] = model.languages[best[i]], p[i, best[i]]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(names), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double").withColumn("rejected", F.col("score") < REJECT)
