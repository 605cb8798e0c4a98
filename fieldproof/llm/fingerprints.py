"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the ``size`` smallest of a text's distinct shingle hashes, as base64 of big-endian 64-bit words in rising
order; a text with at most that many shingles is stored whole. Sketches of parts merge into the sketch of the whole
(:func:`merge`), and two sketches give estimates of resemblance, containment and distinct counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, stored, text_column

SIZE = 128


def encode(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u8").tobytes()).decode()


def decode(sketch: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(sketch), ">u8").astype(np.uint64)


def bottom(values: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The smallest distinct values in rising order."""
    if len(values) > 8 * size:
        for n in (4 * size, 16 * size, 64 * size):
            if n < len(values):
                some = np.unique(np.partition(values, n)[:n])
                if len(some) >= size:
                    return some[:size]
    return np.unique(values)[:size]


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of the union of what a and b are sketches of."""
    return np.union1d(a, b)[:size]


def distinct_count(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact for sketches that aren't full."""
    return float(len(a)) if len(a) < size else (size - 1) / ((float(a[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated |A & B| / |A | B|; two empty sets are alike."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    union = merge(a, b, size)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of A that is in B; an empty A is contained in anything."""
    if len(a) == 0:
        return 1.0
    joint = distinct_count(merge(a, b, size), size)
    return min(1.0, resemblance(a, b, size) * joint / distinct_count(a, size))


def sketches(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sketch of each text of an Arrow column."""
    out: list[np.ndarray] = []
    holder = pa.RecordBatch.from_arrays([column], names=["text"])
    for part in K.chunks(holder, "text"):
        values, bounds = K.text_shingles(part.column("text"))
        out += [bottom(values[a:b], size) for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint, distinct_shingles) per row; null and blank texts have the empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sketches(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(encode, made), pa.string()), pa.array([distinct_count(x, size) for x in made], pa.float64())],
                names=["doc_id", "fingerprint", "distinct_shingles"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double")


def merge_parts(parts: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """(key, fingerprint): the sketch of each key's whole from its parts' column ``fingerprint``.

    Two steps, so that a key with very many parts is merged in pieces of bounded size first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1).to_pylist()
            made = [encode(bottom(np.concatenate([decode(x) for x in many if x is not None] or [np.empty(0, np.uint64)]), size)) for many in lists]
            yield pa.RecordBatch.from_arrays([keys, pa.array(made, pa.string())], names=[key, "fingerprint"])

    kind = parts.schema[key].dataType.simpleString()
    out = parts.select(key, "fingerprint")
    for spread in (4096, 64, 1):
        gathered = out.withColumn("_g", F.pmod(F.xxhash64("fingerprint"), F.lit(spread))).groupBy(key, "_g").agg(F.collect_list("fingerprint").alias("_l"))
        out = gathered.select(key, "_l").mapInArrow(run, f"`{key}` {kind}, fingerprint string")
    return out


def _heads(keys: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The first key (a, b) of each of about so many ranges of rows, in order: 16 bytes per task of the main pass."""
    dealt = keys.repartitionByRange(ranges, "a", "b").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("a", "b")).alias("head"))
    found = sorted({(r.head.a, r.head.b) for r in dealt.collect()})
    return np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], np.int64)


def _ranges(sent):
    """Of keys (a, b): twice the range they lie in, and one more for the first key of a range."""

    @F.pandas_udf("long")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        heads_a, heads_b = sent.value
        a, b = a.to_numpy(np.int64), b.to_numpy(np.int64)
        low, high = np.searchsorted(heads_a, a, "left"), np.searchsorted(heads_a, a, "right")
        at = low - 1
        for i in np.flatnonzero(high > low):  # ids that begin a range, or fill several
            at[i] = low[i] + np.searchsorted(heads_b[low[i] : high[i]], b[i], "right") - 1
        at = np.maximum(at, 0)
        return pd.Series(2 * at + ((heads_a[at] == a) & (heads_b[at] == b)))

    return place.asNondeterministic()


def _edit(size: int):
    """Rows of whole ranges in order, each range ended by the document that follows it (guest)."""

    def _edited_rows(out: list) -> pa.RecordBatch:
        cuts = [len(a[1]) // 3 for a, _ in out]
        edited = [a[1][: len(a[1]) - c] + b[1][:c] for (a, b), c in zip(out, cuts)]
        column = pa.array(edited, pa.string())
        made = sketches(column, size)
        return pa.RecordBatch.from_arrays([
            pa.array([a[0] for a, _ in out], pa.int64()),
            pa.array([len(a[1]) for a, _ in out], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([encode(a[2]) for a, _ in out], pa.string()),
            pa.array([encode(x) for x in made], pa.string()),
            pa.array([resemblance(a[2], x, size) for (a, _), x in zip(out, made)], pa.float64()),
            pa.array([resemblance(a[2], b[2], size) for a, b in out], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in K.chunks(batch, "text"):
                rows = list(zip(part.column("r").to_pylist(), part.column("guest").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), sketches(part.column("text"), size)))
                out = []
                for r, guest, doc_id, text, sketch in rows:
                    now = (doc_id, text or "", sketch)
                    if held is not None and held[0] == r:
                        out.append((held[1], now))
                    held = None if guest else (r, now)
                yield _edited_rows(out)

    return run


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, range_bytes: int = 64 << 20, least_tasks: int = 32) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and the likeness to the next text.

    The next document is the one of the next smaller doc_id; after the smallest comes the largest. The edited text has
    its last floor(n / 3) code points replaced by the next text's first as many, or all of them where it has fewer. A
    null text reads as empty. Rows of the same doc_id follow each other by their texts' hashes; rows without a doc_id come
    after all others, likewise. One document alone follows itself; an empty table gives an empty result.

    Documents are dealt out once by ranges of (doc_id, text hash) of about ``range_bytes``, so that an id on very many
    rows fills several; there are ``least_tasks`` where these have a megabyte each. The first document of each range is
    dealt to the range before it too, so that no row needs a look into another task.
    """
    base = text_column(docs, id_col, text_col)
    lowest = F.lit(-(2**63)).cast("long")
    a, b = F.bitwise_not(F.coalesce("doc_id", lowest)), F.xxhash64("text")
    keys = stored(base.select(a.alias("a"), b.alias("b"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), "order")
    total = keys.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    if not total.rows:
        return base.mapInArrow(_edit(size), _SCHEMA)
    heads = _heads(keys, max(1, total.n // range_bytes, min(least_tasks, total.n >> 20)))
    discard(keys)
    n = len(heads[0])
    placed = base.select("doc_id", "text", a.alias("a"), b.alias("b")).withColumn("at", _ranges(docs.sparkSession.sparkContext.broadcast(heads))("a", "b"))
    own, before = F.expr("at div 2").cast("int"), F.expr(f"pmod(at div 2 - 1, {n})").cast("int")
    to = F.when(F.expr("at % 2 = 1"), F.array(F.struct(own.alias("r"), F.lit(False).alias("guest")), F.struct(before.alias("r"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(own.alias("r"), F.lit(False).alias("guest"))))
    rows = placed.select("doc_id", "text", "a", "b", F.explode(to).alias("to")).select("to.r", "to.guest", "a", "b", "doc_id", "text")
    dealt = rows.repartitionById(n, F.col("r"))
    return dealt.sortWithinPartitions("r", "guest", "a", "b").select("r", "guest", "doc_id", "text").mapInArrow(_edit(size), _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
