"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased, everything but letters is one space. Each language has a 4-gram model (absolute discount at every
order, continuation counts below the highest, a uniform floor). A 4-gram packs into one 64-bit key of four UTF-16 units,
so that its context is the key shifted and its lower orders are masks of it. The models are compiled into sorted key
arrays, one per order over all languages; scoring is binary search. Few languages have one row of log-probabilities or
back-off weights per key; where those rows would exceed ``DENSE_BYTES``, each key has a list of (language, value) pairs. The language of the lowest cross-entropy per character wins. The confidence
is a softmax of the cross-entropies whose sharpness is calibrated on sampled texts that the models of another half of
the sample score; a text far above the cross-entropies seen there is marked as rejected and its confidence halved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, small_batches, stored, text_column

ORDER = 4
#: Expected number of labelled rows that training takes of each language at most.
PER_LANGUAGE = 600
#: Languages that are learned at most: those with the most labelled rows.
MOST_LANGUAGES = 1000
#: Above this size the compiled models keep pairs in place of rows with a column per language.
DENSE_BYTES = 64 << 20
UNKNOWN = "und"
_U = np.uint64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case of each code point, which are letters)"""
    chars = [chr(i) for i in range(0x110000)]
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for i, c in enumerate(chars):
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return lower, letter


def _utf16(points: np.ndarray) -> np.ndarray:
    """Code points as UTF-16 units: those above 0xFFFF are two."""
    pair = points > _U(0xFFFF)
    out = np.repeat(points, 1 + pair)
    first = (np.cumsum(1 + pair) - 1 - pair)[pair]
    over = points[pair] - _U(0x10000)
    out[first], out[first + 1] = _U(0xD800) + (over >> _U(10)), _U(0xDC00) + (over & _U(0x3FF))
    return out


def keys(column: pa.Array) -> Iterator[np.ndarray]:
    """The 4-gram keys of each text, one per character that is kept; none for a text without a letter."""
    lower, letter = _tables()
    raw, off = K.text_bytes(column)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    is_letter = letter[points]
    folded = np.where(is_letter, lower[points], 32).astype(_U)
    wide = bool(len(folded)) and int(folded.max()) > 0xFFFF
    for a, b in zip(at[:-1], at[1:]):
        m = is_letter[a:b]
        if not m.any():
            yield np.empty(0, _U)
            continue
        keep = m.copy()
        keep[1:] |= m[:-1]
        own = folded[a:b][keep]
        x = np.concatenate((np.full(ORDER - 1, 32, _U), _utf16(own) if wide else own))
        yield x[:-3] << _U(48) | x[1:-2] << _U(32) | x[2:-1] << _U(16) | x[3:]


def _mask(order: int) -> np.uint64:
    return _U((1 << 16 * order) - 1)


class Rows:
    """Per sorted key one value for each of some languages: as rows of all languages, or as lists of pairs."""

    def __init__(self, per: list[tuple[np.ndarray, np.ndarray]], dense_bytes: int):
        """per: each language's sorted keys and values."""
        self.keys = np.unique(np.concatenate([k for k, _ in per])) if per else np.empty(0, _U)
        self.n, self.values, self.own = len(per), None, None
        places = [np.searchsorted(self.keys, k) for k, _ in per]
        if len(self.keys) * self.n * 5 <= dense_bytes:
            self.values = np.zeros((len(self.keys), self.n), np.float32)
            self.own = np.zeros((len(self.keys), self.n), bool)
            for j, (at, (_, v)) in enumerate(zip(places, per)):
                self.values[at, j], self.own[at, j] = v, True
        else:
            at = np.concatenate(places)
            order = np.argsort(at, kind="stable")
            self.language = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in places])[order]
            self.value = np.concatenate([v for _, v in per]).astype(np.float32)[order]
            self.first = np.searchsorted(at[order], np.arange(len(self.keys) + 1))

    def put(self, codes: np.ndarray, out: np.ndarray, add: bool) -> None:
        """Add to out, or set in it, the values of the languages that have each code."""
        if not len(self.keys) or not len(codes):
            return
        at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == codes)
        at = at[row]
        if self.values is not None:
            out[row] = out[row] + self.values[at] if add else np.where(self.own[at], self.values[at], out[row])
            return
        count = self.first[at + 1] - self.first[at]
        flat = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        row = np.repeat(row, count)
        if add:
            out[row, self.language[flat]] += self.value[flat]
        else:
            out[row, self.language[flat]] = self.value[flat]


@dataclass
class Models:
    """Compiled models: per order the log-probabilities of keys and the back-off weights of contexts.

    ``grams`` and ``logs``, where languages are few, hold the log-probabilities of all languages for every key, those
    that back off included, so that most characters cost one search.
    """

    languages: list[str]
    logs_of: list[Rows]
    backs_of: list[Rows]
    floor: float
    sharpness: float = 0.05
    usual: tuple[float, float] = (0.0, 1e9)
    grams: list[np.ndarray] | None = None
    logs: list[np.ndarray] | None = None

    def compile(self) -> Models:
        if all(x.values is not None for x in self.logs_of):
            self.grams, self.logs = [], []
            for order in range(1, ORDER + 1):
                made = self.rows(self.logs_of[order - 1].keys, order)
                self.grams.append(self.logs_of[order - 1].keys)
                self.logs.append(made)
        return self

    def rows(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log P of each key's last unit given the ones before, a column per language."""
        if order == 0:
            return np.full((len(codes), len(self.languages)), self.floor, np.float32)
        if self.grams is not None and len(self.grams) >= order and len(self.grams[order - 1]):
            known, logs = self.grams[order - 1], self.logs[order - 1]
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            out = logs[at]
            miss = np.flatnonzero(known[at] != codes)
            if len(miss):
                out[miss] = self._backed_off(codes[miss], order)
            return out
        out = self._backed_off(codes, order)
        self.logs_of[order - 1].put(codes, out, add=False)
        return out

    def _backed_off(self, codes: np.ndarray, order: int) -> np.ndarray:
        out = self.rows(codes & _mask(order - 1), order - 1)
        self.backs_of[order - 1].put(codes >> _U(16), out, add=True)
        return out

    def entropies(self, codes: np.ndarray) -> np.ndarray:
        step = max(1024, (4 << 20) // max(1, len(self.languages)))
        return -sum(self.rows(codes[i : i + step]).sum(axis=0, dtype=np.float64) for i in range(0, len(codes), step)) / len(codes)

    def decide(self, codes: np.ndarray) -> tuple[str, float, bool]:
        """(language, confidence, rejected)"""
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0, True
        h = self.entropies(codes)
        best = int(h.argmin())
        score = 1 / np.exp(np.clip((h[best] - h) * len(codes) * self.sharpness, -60, 0)).sum()
        far = bool(h[best] > self.usual[0] + self.usual[1] * (1 + 8 / np.sqrt(len(codes))))
        return self.languages[best], float(score) * (0.5 if far else 1.0), far


def _one(orders: list[tuple[np.ndarray, np.ndarray]], floor: float, discount: float) -> tuple[list, list]:
    """One language's (keys, log-probabilities) and (contexts, log back-off weights) by order, from its counts."""
    logs: list[tuple[np.ndarray, np.ndarray]] = []
    backs: list[tuple[np.ndarray, np.ndarray]] = []
    for order, (code, n) in enumerate(orders, 1):
        contexts, first = np.unique(code >> _U(16), return_index=True)
        total = np.add.reduceat(n, first) if len(n) else n
        kinds = np.diff(np.concatenate((first, [len(code)])))
        back = np.log(discount * kinds / np.maximum(total, 1e-9))
        at = np.repeat(np.arange(len(contexts)), kinds)
        # every suffix of a key is a key of the order below
        lower = logs[-1][1][np.searchsorted(logs[-1][0], code & _mask(order - 1))] if order > 1 else np.full(len(code), floor)
        logs.append((code, np.log(np.maximum(n - discount, 0) / np.maximum(total[at], 1e-9) + np.exp(back[at] + lower))))
        backs.append((contexts, back))
    return logs, backs


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]], discount: float = 0.75, dense_bytes: int = DENSE_BYTES) -> Models:
    """Models from each language's sorted 4-gram keys and their counts."""
    languages = sorted(counts)
    per: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        code, n = counts[lang]
        orders = [(code, n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: how many units stand before
            code, n = np.unique(orders[-1][0] & _mask(order), return_counts=True)
            orders.append((code, n.astype(np.float64)))
        per.append(orders[::-1])
    units = np.unique(np.concatenate([orders[0][0] for orders in per])) if per else []
    floor = float(np.log(1 / (len(units) + 1)))
    made = [_one(orders, floor, discount) for orders in per]
    of = lambda which: [Rows([m[which][order] for m in made], dense_bytes // ORDER) for order in range(ORDER)]
    return Models(languages, of(0), of(1), floor).compile()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owns, half = batch.column("own").to_pylist(), batch.column("half").to_pylist()
        gathered: dict[tuple[int, int], list[np.ndarray]] = {}
        for part_keys, own, h in zip(keys(batch.column("text")), owns, half):
            gathered.setdefault((own, h), []).append(part_keys)
        for (own, h), many in gathered.items():
            code, n = np.unique(np.concatenate(many), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(code), pa.int32()), pa.array([h] * len(code), pa.int32()), K.as_i64(code), pa.array(n)], names=["own", "half", "code", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, held_out=None, per_language: int = PER_LANGUAGE) -> Models:
    """Models of all languages from a bounded sample of labelled rows: those with the smallest hashes of doc_id, about
    ``per_language`` of each language. Rows with a null text or language, or within ``held_out``, teach nothing, nor do
    languages beyond the ``MOST_LANGUAGES`` with the most rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    if held_out is not None:
        rows = rows.where(~held_out)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("of")).orderBy(F.desc("of"), "lang").limit(MOST_LANGUAGES)
    languages = sorted((r.lang, r.of) for r in sizes.collect())
    if not languages:
        return train({})
    sizes = docs.sparkSession.createDataFrame([(lang, n, i) for i, (lang, n) in enumerate(languages)], "lang string, of long, own int")
    sample = rows.join(F.broadcast(sizes), "lang").where(F.expr(f"pmod(xxhash64(doc_id), 1000000007) < 1000000007D * {per_language} / of"))
    # a bounded table, read by the counts and by the calibration
    counted = stored(sample.select("own", "text", F.expr("cast(pmod(xxhash64(doc_id, 1), 4) = 0 as int)").alias("half")), "sample")
    table = counted.mapInArrow(_count, "own int, half int, code long, n long").groupBy("own", "half", "code").agg(F.sum("n").alias("n")).toArrow()
    own, half = np.asarray(table.column("own")), np.asarray(table.column("half"))
    code, n = np.asarray(table.column("code")).view(_U), np.asarray(table.column("n"))

    def of(use: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for i in np.unique(own[use]).tolist():
            pick = use & (own == i)
            values, where = np.unique(code[pick], return_inverse=True)
            out[languages[i][0]] = values, np.bincount(where, n[pick])
        return out

    models = train(of(np.ones(len(code), bool)))
    if (half == 0).any() and (half == 1).any():
        _calibrate(models, train(of(half == 0)), counted.where("half = 1").join(F.broadcast(sizes), "own").select("lang", "text"))
    discard(counted)
    return models


def _calibrate(models: Models, trial: Models, held: DataFrame) -> None:
    """Sharpness and usual cross-entropy from texts that the trial models haven't seen.

    Workers add up the loss of each sharpness; the driver gets those sums and a number per text of the bounded sample.
    """
    sent = held.sparkSession.sparkContext.broadcast(trial)
    tries = np.geomspace(1e-3, 1, 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(sent.value.languages)}
        for batch in batches:
            best, loss = [], np.zeros(len(tries))
            for c, lang in zip(keys(batch.column("text")), batch.column("lang").to_pylist()):
                if len(c) and lang in place:
                    h = sent.value.entropies(c)
                    best.append(float(h.min()))
                    z = np.clip(-(h - h.min()) * len(c) * tries[:, None], -60, 0)
                    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
                    loss -= np.log(np.maximum(p[:, place[lang]], 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array([best], pa.list_(pa.float64())), pa.array([loss.tolist()], pa.list_(pa.float64()))], names=["best", "loss"])

    table = held.mapInArrow(run, "best array<double>, loss array<double>").toArrow()
    best = table.column("best").combine_chunks().flatten().to_numpy() if table.num_rows else np.empty(0)
    if not len(best):
        return
    models.usual = float(np.median(best)), float(max(0.05, 6 * np.median(np.abs(best - np.median(best)))))
    models.sharpness = float(tries[int(np.argmin(np.sum(table.column("loss").to_pylist(), axis=0)))])


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row; ``und`` with score 0 for a null text or one without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, "text"):
                made = [sent.value.decide(c) for c in keys(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64()), pa.array([x[2] for x in made], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, parts: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected per row.

    Learns from rows whose crc32(doc_id as text) mod ``parts`` is not ``held``. Without any labelled row every text is
    ``und``; repeated rows and rows without a doc_id (held_out null) are predicted like any other.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % parts == held
    models = fit(docs, id_col, text_col, lang_col, held_out=fold, per_language=per_language)
    return identify(docs, models, id_col, text_col).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")
