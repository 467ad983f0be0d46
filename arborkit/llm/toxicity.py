"""Toxicity severity by cumulative-link (proportional-odds) regression.

Grades are ordered: 0 not toxic, 1 toxic, 2 severely toxic.  Labels that tell
toxic rows only (0/1) are graded for training: a toxic row that holds more of the
screened words than the usual (median) toxic row is severe.  One
weight vector over hashed words serves every threshold: ``P(grade >= k) =
sigmoid(w.x - t_k)`` with ``t_1 < t_2``.  A text's features are its distinct
words, word beginnings, and beginnings that two or three of its distinct words share (a stem
that clean words meet by chance recurs in toxic texts); ASCII letters lower-cased, other ASCII
as separators, whole text.
Features are screened and weights fitted by proximal gradient in numpy on a bounded
sample of labelled rows (``MAX_LABELLED``, lowest id hashes); scoring covers every row.

Output: ``severity`` (expected grade), ``p_toxic`` (P(grade >= 1)) and ``toxic``
(p_toxic >= 0.5).  Null or wordless text: severity and p_toxic 0, not toxic.
Null or unmatched labels are not trained on; without both toxic and clean labels
nothing is toxic.  Of labelled rows that share an id only one is trained on (the
one whose text has the least hash), so the bound holds for rows as well.  Repeated
rows score alike.  Texts of any length are read whole.  Extra columns pass
through, but for older ones named like an output.  Empty table: empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, hash_words, schema_of, slices, unboxed

#: Bound of the training sample in rows; hashed features; least documents that a feature is in.
MAX_LABELLED, BUCKET_BITS, MIN_DOCS = 6000, 22, 5
#: Lengths in bytes of word beginnings, for words built on a stem.
BEGINNINGS = (4, 5, 6)
#: Most distinct words sharing a beginning that are told apart.
SHARED = 3
GRADES = 3
SCREEN, SCREEN_Z, L1, STEPS = 0.5, 3.5, 1e-6, 3000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a whole text's words, beginnings and shared beginnings."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) if text else set()
    found = list(words)
    for n in BEGINNINGS:
        for start, times in Counter([w[:n] for w in words if len(w) >= n]).items():
            found.extend(b"^" * level + start for level in range(1, min(times, SHARED) + 1))
    return np.unique(hash_words(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., one row a document."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel | None:
    """Screen features, then fit weights and thresholds on those that remain.

    A feature stays if toxic rows are at least ``SCREEN`` of the rows that hold
    it, by the lower Wilson bound at ``SCREEN_Z``: words of single mislabelled
    texts fall out, and weights of the rest need little restraint.
    """
    if not len(rows) or (grades > 0).all() or (grades == 0).all():
        return None
    lengths = np.array([len(x) for x in rows])
    columns, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    held = np.bincount(columns, minlength=1 << BUCKET_BITS)
    toxic = np.bincount(columns[grades[owner] > 0], minlength=1 << BUCKET_BITS)
    share, z2 = toxic / np.maximum(held, 1), SCREEN_Z**2
    lower = (share + z2 / (2 * np.maximum(held, 1)) - SCREEN_Z * np.sqrt(share * (1 - share) / np.maximum(held, 1) + z2 / (4.0 * np.maximum(held, 1) ** 2))) / (1 + z2 / np.maximum(held, 1))
    names = np.flatnonzero((held >= MIN_DOCS) & (lower >= SCREEN))
    place = np.full(1 << BUCKET_BITS, -1)
    place[names] = np.arange(len(names))
    kept = place[columns] >= 0
    hits = np.bincount(owner[kept], minlength=len(rows))
    usual = np.median(hits[(grades == 1) & (hits > 0)]) if ((grades == 1) & (hits > 0)).any() else 0
    grades = np.where((grades == 1) & (hits > usual), 2, grades)
    w, t = _descend(place[columns[kept]], owner[kept], len(names), grades, L1, STEPS)
    weights = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
    weights[names] = w
    return OrdinalModel(weights, t)


def _descend(columns: np.ndarray, owner: np.ndarray, width: int, grades: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient on the mean negative log-likelihood; weights and thresholds."""
    n, k = len(grades), GRADES - 1
    w = np.zeros(width)
    share = np.clip(np.array([(grades >= j + 1).mean() for j in range(k)]), 1e-4, 1 - 1e-4)
    t = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    scale = 1.0 / np.sqrt(np.bincount(columns, minlength=width) / n + 1e-3)  # per-feature steps
    at = np.arange(n)
    for step in range(steps):
        z = np.bincount(owner, weights=w[columns], minlength=n)
        up = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -40, 40)))
        edge = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        slope = edge * (1 - edge)
        p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-9)
        dz = -(slope[at, grades] - slope[at, grades + 1]) / p
        gw = np.bincount(columns, weights=dz[owner], minlength=width) / n
        gt = np.array([((np.where(grades == j + 1, slope[:, j + 1], 0) - np.where(grades == j, slope[:, j + 1], 0)) / p).sum() for j in range(k)]) / n
        rate = 1.0 / (1 + step / 1000)
        w -= rate * scale * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * scale * l1, 0)
        t = np.maximum.accumulate(t - rate * gt + np.r_[0, np.full(k - 1, 1e-9)])
    return w, t


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel | None:
    """Fit on the labelled rows with the lowest id hashes, at most MAX_LABELLED."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    grade = F.least(F.greatest(F.col("toxic"), F.lit(0)), F.lit(GRADES - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", grade.cast("int").alias("grade"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(x) for x in batch.column(1).to_pylist()]
            order = [hash_words([x.encode("utf-8", "surrogatepass") if x else b""]).view(np.int64)[0] for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(order, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "grade", "hash", "features"])

    found = rows.mapInArrow(run, "doc_id long, grade int, hash long, features binary")
    # one row an id: at most MAX_LABELLED reach the driver
    found = found.groupBy("doc_id", "grade").agg(F.min(F.struct("hash", "features")).alias("f"))
    sample = found.select("doc_id", "grade", F.col("f.features").alias("features")).toArrow()
    order = np.argsort(sample.column("doc_id").to_numpy(), kind="stable")
    found = [np.frombuffer(x, dtype=np.int32) for x in sample.column("features").to_pylist()]
    return fit([found[i] for i in order], sample.column("grade").to_numpy()[order].astype(np.int64))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``severity, p_toxic, toxic``."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("severity", "p_toxic", "toxic")]
    schema = schema_of(docs, own, "severity double, p_toxic double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            found = [features(x) if m else () for x in batch.column("text").to_pylist()]
            if m:
                score = np.array([m.weights[x].sum() for x in found])
                up = m.above(score) * np.array([[len(x) > 0] for x in found])
            else:
                up = np.zeros((len(found), GRADES - 1))
            yield pa.record_batch([*(batch.column(c) for c in own), pa.array(up.sum(axis=1)), pa.array(up[:, 0])], names=[*own, "severity", "p_toxic"])

    return docs.select(*own).mapInArrow(run, schema).withColumn("toxic", F.col("p_toxic") >= 0.5)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows judged toxic."""
    read = ("doc_id", "text")
    return unboxed(score_toxicity(boxed(docs, *read), labels).where("not toxic"), docs.columns, read)
