"""Phrase collocations by Apriori passes, one per length.

Pass 1 counts words per language, pass k runs of k words, and a run is emitted only where both runs of k - 1 words in it
are frequent: the tasks get the frequent ones of the pass before as a broadcast of 64-bit hashes. Up to ``EXACT`` of
them that is a sorted array; beyond it a bitmap of fixed size, filled by a Spark aggregation, that lets some infrequent
runs through. Neither array decides a result: what passes is counted under its words themselves, and infrequent runs go
after counting. So memory is bounded at every size and counts are exact.

Each chunk of a batch counts its runs before they leave the task, so a very frequent word or run is a row per chunk.
Cuts of the candidates are scored by joins with the tables of the levels; these are stored first, so that a part that
very many candidates share can be split. The first rows of a language are taken in two steps, by hash of the phrase and
then over what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import spans
from .shared import discard, small_batches, stored

LEAST, LONGEST, REPORTED = 30, 4, 2000
#: Frequent runs of a level up to which their hashes are broadcast; beyond it the words of a bitmap of as many bytes.
EXACT = 1 << 22
CHUNK_BYTES = 2 << 20
#: Parts of a language whose first rows are taken before those of the language.
PARTS = 16

_ENDS = spans.byte_class((0x0A, 0x0D))
_ENDS[list(b".,;:!?")] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_COUNTS = "lang string, phrase string, f long"


class Frequent:
    """Which hashes are those of frequent runs: exact for a sorted array, and never a miss for a bitmap."""

    def __init__(self, values: np.ndarray, bits: bool) -> None:
        self.values, self.bits = values, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.bits:
            word = self.values[(h >> K.U64(6)) & K.U64(len(self.values) - 1)]
            return (word >> (h & K.U64(63))) & K.U64(1) != 0
        if not len(self.values):
            return np.zeros(len(h), bool)
        return self.values[np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)] == h


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each phrase (lang, phrase), as :func:`_runs` makes it."""
    for batch in batches:
        if batch.num_rows:
            raw, off = K.text_bytes(batch.column("phrase"))
            start, end, row = spans.runs(raw, off, _WORD)
            word, words = spans.named(raw, start, end)
            lang, langs = spans.coded(batch.column("lang"))
            each = K.mix(spans.value_hashes(words)[word] ^ K.mix(spans.value_hashes(langs))[lang[row]])
            first = np.searchsorted(row, np.arange(batch.num_rows))
            length = np.bincount(row, minlength=batch.num_rows)
            h = each[first]
            for j in range(1, int(length.max())):
                longer = np.flatnonzero(length > j)
                h[longer] = _joined(h[longer], each[first[longer] + j])
            yield pa.RecordBatch.from_arrays([K.as_i64(h)], names=["h"])


def frequent(level: DataFrame, exact: int = EXACT) -> Frequent:
    """The hashes of a level's rows (lang, phrase); at most ``exact`` numbers (a power of two) reach the driver, whatever
    its size. They are made here and not carried through the counting, whose rows they would make longer by a third."""
    level = level.select("lang", "phrase").mapInArrow(_hashed, "h long")
    return _set_of(level, exact)


def _set_of(level: DataFrame, exact: int) -> Frequent:
    if level.count() <= exact:
        found = level.select("h").distinct().toArrow().column("h").to_numpy()
        return Frequent(np.sort(found.astype(np.int64).view(K.U64)), False)
    words = level.select(F.expr(f"shiftrightunsigned(h, 6) & {exact - 1}L").alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(exact, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return Frequent(out.view(K.U64), True)


def _runs(size: int, known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the runs of ``size`` words; pass 1 also gives each language's words under a null phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = known.value.has if known is not None else None
        for batch in batches:
            for part in K.chunks(batch, "text", CHUNK_BYTES):
                raw, off = K.text_bytes(part.column("text"))
                raw = K.LOWER[raw]
                start, end, text = spans.runs(raw, off, _WORD)
                if not len(start):
                    continue
                lang_of, langs = spans.coded(part.column("lang"))
                lang = lang_of[text]
                word, words = spans.named(raw, start, end)
                h = K.mix(spans.value_hashes(words)[word] ^ K.mix(spans.value_hashes(langs))[lang])
                if size == 1:
                    total = np.bincount(lang, minlength=len(langs))
                    yield _rows(langs, pa.nulls(len(langs), pa.string()), total)
                    at = np.arange(len(word))
                else:
                    # runs of up to size words from each word on stay within a piece
                    piece = np.searchsorted(np.flatnonzero(_ENDS[raw]), start)
                    joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
                    part_h, whole = h, np.ones(len(word), bool)
                    for j in range(1, size - 1):
                        part_h = _longer(part_h, h, j)
                        whole = whole[:-1] & joined[j - 1 :]
                    # both runs of size - 1 words, from a word and from the one after it, hold together and are frequent
                    at = np.flatnonzero(whole[:-1] & whole[1:] & joined[: max(0, len(whole) - 1)])
                    at = at[has(part_h[at])]
                    at = at[has(part_h[at + 1])]
                    if not len(at):
                        continue
                # exact names: (language and words so far, next word), numbered anew at each step
                name = lang[at]
                for j in range(size):
                    _, name = np.unique(name * np.int64(len(words)) + word[at + j], return_inverse=True)
                _, first, times = np.unique(name, return_index=True, return_counts=True)
                at = at[first]
                each = [words.take(pa.array(word[at + j])) for j in range(size)]
                phrase = pc.binary_join_element_wise(*each, pa.scalar(b" ", pa.large_binary())) if size > 1 else each[0]
                yield _rows(langs.take(pa.array(lang[at])), phrase.cast(pa.binary()).cast(pa.string()), times)

    return count


def _longer(part: np.ndarray, word: np.ndarray, j: int) -> np.ndarray:
    """Hashes of runs made one word longer, from runs of j words; one fewer than before."""
    return _joined(part[: len(word) - j], word[j:])


def _joined(part: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(part * K.U64(0x9E3779B97F4A7C15) + word)


def _rows(lang: pa.Array, phrase: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(times.astype(np.int64))], names=["lang", "phrase", "f"])


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = LEAST, longest: int = LONGEST, exact: int = EXACT) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all words of each language; (lang, k, phrase, f): all runs of 1 to ``longest`` words with f >= least.

    Both are stored tables. Null texts have no words, null languages are ``und``.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    made: list[DataFrame] = []
    totals, known = None, None
    for k in range(1, longest + 1):
        counts = narrow.mapInArrow(_runs(k, known), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        table = stored(counts.where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{k}")
        if known is not None:
            known.destroy()
        if k == 1:
            totals = table.where("phrase is null").select("lang", F.col("f").alias("n"))
        made.append(table)
        if k < longest:
            known = docs.sparkSession.sparkContext.broadcast(frequent(table.where("phrase is not null"), exact))
    every = reduce(DataFrame.unionByName, [t.where("phrase is not null").select("lang", F.lit(k + 1).alias("k"), "phrase", "f") for k, t in enumerate(made)])
    return stored(totals, "phrase-words"), _discarding(stored(every, "phrase-levels"), made)


def _discarding(table: DataFrame, parts: list[DataFrame]) -> DataFrame:
    discard(*parts)
    return table


def scored(level: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, score): candidates of two words and more with their lowest-scoring cut."""
    cuts = level.where("k > 1").select(
        "lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).select("lang", "k", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("tail"))
    parts = level.where(F.col("k") < level.agg(F.max("k")).first()[0])
    side = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    # decimals: 2,000,000 times a count may pass 64 bits
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return both.groupBy("lang", "k", "phrase", "a").agg(least).select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, level: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates that no longer candidate holds with ``percent`` of their count or more.

    Where a run of k + 2 words holds one, a run of k + 1 words between them does, at least as often; so the next length
    decides.
    """
    longer = level.where("k > 2").select("lang", (F.col("k") - 1).alias("k"), "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    most = stored(longer.groupBy("lang", "k", "phrase").agg(F.max("f").alias("held")), "phrase-held")
    return candidates.join(most, ["lang", "k", "phrase"], "left").where(F.expr(f"held is null or cast(held as decimal(22, 0)) * 100 < cast(a as decimal(22, 0)) * {percent}")).drop("held")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = LEAST, longest: int = LONGEST, reported: int = REPORTED, percent: int = 80, exact: int = EXACT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``reported`` phrases.

    Null and empty texts have no words, a null language is ``und``; a repeated row counts each time. Ties in score go by
    count, then by phrase in UTF-8 order. A language without a phrase has no row, an empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    words, level = levels(docs, text_col, lang_col, least=least, longest=longest, exact=exact)
    if level.isEmpty():
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    kept = uncovered(scored(level), level, percent).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= reported)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= reported)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
