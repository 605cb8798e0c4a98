"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are bytes with A-Z lower-cased and everything that is neither a letter nor part of a non-ASCII character read as
a space. Features are hashed n-grams, counted once a text: all 5-grams, and the n-grams of 3 to 10 bytes that begin a
word (a word's beginning tells more than the same letters inside). Each is scaled by the log ratio of its counts in
toxic and clean training texts; a ratio that chance explains counts as zero. A logistic regression is trained over the
scaled features. Training takes a bounded sample of labelled rows (``per_class`` of either label, those of the smallest
hashes of doc_id); scoring takes every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, stored, text_column

BITS = 20
INSIDE = 5
STARTS = range(3, 11)
#: Labelled rows of either class that training takes at most.
PER_CLASS = 3000
REJECT_FROM = 0.7

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of n-gram (hashed n-grams in order, per text the index of its first one)."""
    x = _FOLD[raw]
    n, out = len(x), []
    with np.errstate(over="ignore"):
        packed = np.zeros(max(0, n - INSIDE + 1), np.uint64)
        for j in range(INSIDE):
            packed |= x[j : n - INSIDE + 1 + j].astype(np.uint64) << np.uint64(8 * j)
        # an n-gram that runs into the next text goes to nobody
        first = np.minimum(off, len(packed))
        out.append(((packed * _MULT) >> np.uint64(64 - BITS), np.stack((first[:-1], np.maximum(first[:-1], np.minimum(off[1:] - INSIDE + 1, len(packed)))))))
        letter = x != 32
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        cut = off[1:-1][off[1:-1] < n]
        start[cut] |= letter[cut]
        at = np.flatnonzero(start)
        stop = letter.copy()
        stop[:-1] &= ~letter[1:]
        stop[off[1:-1][off[1:-1] > 0] - 1] |= letter[off[1:-1][off[1:-1] > 0] - 1]
        length = np.flatnonzero(stop) + 1 - at
        code = np.zeros(len(at), np.uint64)
        for j in range(max(STARTS)):
            go = length > j
            at, length, code = at[go], length[go], code[go]
            code = K.mix(code * np.uint64(257) + x[at + j] + np.uint64(1))
            if j + 1 in STARTS:
                first = np.searchsorted(at, off)
                out.append((code >> np.uint64(64 - BITS), np.stack((first[:-1], first[1:]))))
    return out


class _Distinct:
    """Distinct values of small integers without sorting; keeps one scratch table."""

    def __init__(self):
        self.mark = np.zeros(1 << BITS, np.int32)

    def __call__(self, idx: np.ndarray) -> np.ndarray:
        at = np.arange(len(idx), dtype=np.int32)
        self.mark[idx] = at
        return idx[self.mark[idx] == at]


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    distinct = _Distinct()
    raw, off = K.text_bytes(column)
    kinds = [(codes.astype(np.int32), bounds) for codes, bounds in grams(raw, off)]
    for i in range(len(off) - 1):
        yield distinct(np.concatenate([codes[bounds[0, i] : bounds[1, i]] for codes, bounds in kinds]))


def fold(doc_id: str, parts: int, held: int):
    return F.crc32(F.col(doc_id).cast("string")) % parts == held


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, bad, good): in how many of the task's texts of either label each feature occurs."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for part in K.chunks(batch, "text"):
            for y, f in zip(part.column("toxic").to_pylist(), features(part.column("text"))):
                counts[y][f] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[1][some]), pa.array(counts[0][some])], names=["feature", "bad", "good"])


def _sample_rows(known):
    """(toxic, features): of each text those features that tell something, as places in the sorted array ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[known.value] = np.arange(len(known.value))
        for batch in batches:
            for part in K.chunks(batch, "text"):
                found = (place[f] for f in features(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([x[x >= 0].tobytes() for x in found], pa.binary())], names=["toxic", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, held_out=None, per_class: int = PER_CLASS, rounds: int = 80, sigmas: float = 3.5) -> tuple[np.ndarray, float]:
    """(weights by feature, bias) from labelled rows outside ``held_out`` (a condition on doc_id)."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if held_out is not None:
        named = named.where(~held_out)
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [named.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class rows of two numbers; their texts are read three times
    sample = stored(text_column(docs, id_col, text_col).join(F.broadcast(picks[0].union(picks[1])), "doc_id").select("toxic", "text"), "sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    out = np.zeros(1 << BITS, np.float32)
    if not n_bad or not n_good:
        return out, -2.0 if n_good or not n_bad else 2.0
    part = n_bad / (n_bad + n_good)
    counted = sample.mapInArrow(_sample_counts, "feature int, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    expected = (F.col("bad") + F.col("good")) * part
    telling = counted.where(F.abs(F.col("bad") - expected) >= sigmas * F.sqrt(expected * (1 - part) + 1)).orderBy("feature").toArrow()
    names, bad, good = (np.asarray(telling.column(c)) for c in ("feature", "bad", "good"))
    r = np.log((bad + 1) / (good * (n_bad / n_good) + 1))
    rows = sample.mapInArrow(_sample_rows(docs.sparkSession.sparkContext.broadcast(names)), "toxic int, features binary").toArrow()
    y = np.asarray(rows.column("toxic")).astype(np.float64)
    discard(sample)
    raw, off = K.text_bytes(rows.column("features"))
    idx = raw.view(np.int32)
    own = np.repeat(np.arange(len(y)), np.diff(off) // 4)
    w, bias = np.full(len(names), 0.05), 0.0
    speed, weight = np.zeros(len(names)), np.where(y == 1, 0.5 / n_bad, 0.5 / n_good)
    scaled = r[idx]
    square = np.full(len(names), 1e-12)
    for _ in range(rounds):
        z = np.bincount(own, scaled * w[idx], minlength=len(y)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(idx, scaled * error[own], minlength=len(names)) + 1e-5 * w
        square += grad**2
        speed = 0.8 * speed + 0.1 * grad / np.sqrt(square)
        w = w - speed
        bias -= 2.0 * error.sum()
    out[names] = w * r
    return out, float(bias)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row; null, empty and very short texts get the bias's score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            for part in K.chunks(batch, "text"):
                z = np.array([weights[f].sum(dtype=np.float64) for f in features(part.column("text"))]) + bias
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, parts: int = 3, held: int = 1, threshold: float = REJECT_FROM, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold``) per row.

    Labels are learned from rows whose crc32(doc_id as text) mod ``parts`` is not ``held``, and only text is an input of
    a score. Unlabelled rows, rows without a doc_id (held_out null) and repeated rows are scored like any other; an
    empty table gives an empty result; without labels every score is low.
    """
    model = fit(docs, labels, id_col, text_col, label_col, held_out=fold("doc_id", parts, held), per_class=per_class)
    return score(docs, model, id_col, text_col).select("doc_id", fold("doc_id", parts, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = REJECT_FROM, **parameters) -> DataFrame:
    """The rows of docs whose text scores under ``threshold``."""
    model = fit(docs, labels, id_col, text_col, **parameters)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            for part in K.chunks(batch, text_col):
                z = [weights[f].sum(dtype=np.float64) + bias for f in features(part.column(text_col))]
                yield part.filter(pa.array([1 / (1 + np.exp(-np.clip(x, -40, 40))) < threshold for x in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
