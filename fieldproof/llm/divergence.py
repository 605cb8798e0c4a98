"""Source divergence audit by a baseline-correction inverted index.

Sources of a language are compared over its V kept terms. Were all counts of two sources zero, the pair would have V
times f of their shares at zero: that is where each pair starts. Only what occurs corrects it, in two kinds of rows:

* one side: a source's term with share p, against the other source's zero share. That depends on the pair and p alone,
  so a source's terms are counted by p first, and each distinct p meets the other sources once;
* both sides: a term that both sources hold corrects what the two one-sided rows counted. Only these rows come from the
  inverted index, a term's postings joined with themselves.

Shares are whole numbers made in decimals, since a thousand million times a count may pass 64 bits; a share is at most
10**9 + 1, so a squared difference and the sum of f over all terms stay within 64 bits. A term's postings are at most
its language's sources, as are a pair table's rows per source, which the result asks for. Tables that a hot language or
source is joined with are stored first, so that its rows can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import spans
from .shared import discard, small_batches, stored

LEAST_DOCS, RANKED = 10, 10
SCALE = 1_000_000_000
CHUNK_BYTES = 2 << 20

_LETTER = spans.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term per (lang, source); each such group also under the empty term."""
    for batch in batches:
        for part in K.chunks(batch, "text", CHUNK_BYTES):
            raw, off = K.text_bytes(part.column("text"))
            raw = K.LOWER[raw]
            start, end, text = spans.runs(raw, off, _LETTER)
            lang, langs = spans.coded(part.column("lang"))
            source, sources = spans.coded(part.column("source"))
            pair, group = np.unique(lang * np.int64(len(sources)) + source, return_inverse=True)
            term, terms = spans.named(raw, start, end) if len(start) else (np.empty(0, np.int64), pa.array([], pa.large_binary()))
            width = np.int64(max(1, len(terms)))
            # a row per term and text, then per term and group
            held, times = np.unique(text * width + term, return_counts=True)
            name, at = np.unique(group[held // width] * width + held % width, return_inverse=True)
            n = np.zeros(len(name), np.int64)
            np.add.at(n, at, times)
            of = np.concatenate((np.arange(len(pair)), name // width))
            none = np.zeros(len(pair), np.int64)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(pair[of] // len(sources))), sources.take(pa.array(pair[of] % len(sources))),
                 pa.concat_arrays([pa.array([""] * len(pair), pa.string()), terms.take(pa.array(name % width)).cast(pa.binary()).cast(pa.string())]),
                 pa.array(np.concatenate((none, n))), pa.array(np.concatenate((none, np.bincount(at, minlength=len(name)).astype(np.int64))))],
                names=["lang", "source", "term", "n", "docs"])


def _share(n: str, total: str) -> str:
    return f"cast({SCALE} as decimal(10, 0)) * (cast({n} as decimal(19, 0)) + 2) div (cast({total} as decimal(19, 0)) + 2 * cast(terms as decimal(19, 0))) + 1"


def _f(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def postings(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The index and its groups, both stored.

    (lang, source, term, p, zero, q) for each kept term and each group that holds it: p is its share, zero the group's
    share of a term that it lacks, q the language's share. (lang, source, terms, zero) for each group, terms being V.
    """
    small_batches(docs.sparkSession)
    column = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    narrow = docs.select(column(text_col, "text"), column(lang_col, "lang"), column(source_col, "source"))
    counts = stored(narrow.mapInArrow(_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = stored(counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
    index = stored(counts.where("term != ''").drop("docs").join(kept, ["lang", "term"]), "divergence-index")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    of_group = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        counts.where("term = ''").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
        # without kept terms there is nothing to share out, and no share is read
        .withColumn("zero", F.expr(f"if(terms = 0, 1, {_share('0', 'total')})")), "divergence-groups")
    shares = index.join(groups, ["lang", "source"]).select("lang", "source", "term", F.expr(_share("n", "total")).alias("p"), "zero", F.expr(_share("all_n", "lang_total")).alias("q"))
    out = stored(shares, "divergence-shares")
    discard(counts, kept, index)
    return out, groups


def pairs(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over the kept terms, for each source and each other source of its language."""
    low = lambda g: g.select("lang", F.col("source").alias("a"), "terms", F.col("zero").alias("zero_a"))
    high = lambda g: g.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    start = low(groups).join(high(groups), "lang").where("a < b").select("lang", "a", "b", F.expr(f"terms * ({_f('zero_a', 'zero_b')})").alias("part"))
    by_share = stored(index.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times")), "divergence-by-share")
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    one = by_share.join(other, "lang").where("source != other").select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        F.expr(f"times * ({_f('p', 'other_zero')} - {_f('zero', 'other_zero')})").alias("part"))
    left = index.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("zero").alias("zero_a"))
    right = index.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    both = left.join(right, ["lang", "term"]).where("a < b").select(
        "lang", "a", "b", F.expr(f"{_f('p_a', 'p_b')} - {_f('p_a', 'zero_b')} - {_f('zero_a', 'p_b')} + {_f('zero_a', 'zero_b')}").alias("part"))
    summed = [x.groupBy("lang", "a", "b").agg(F.sum("part").alias("part")) for x in (start, one, both)]
    value = stored(summed[0].union(summed[1]).union(summed[2]).groupBy("lang", "a", "b").agg(F.sum("part").alias("value")), "divergence-pairs")
    discard(by_share)
    return value.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(value.select("lang", "b", "a", "value"))


def terms(index: DataFrame, ranked: int = RANKED) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group holds more than its language, furthest first.

    A task keeps the first ``ranked`` rows of each group before any shuffle.
    """
    over = index.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    return over.withColumn("rank", F.row_number().over(_places())).where(F.col("rank") <= ranked)


def _places():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, least_docs: int = LEAST_DOCS, ranked: int = RANKED) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources (part ``pair``) and terms of each (part ``term``).

    Null texts, languages and sources read as ''. A repeated row is a further document. A group without terms has pairs
    as any other, with value 0 where its language keeps no term; a language's only source has none. Ties in value go by
    item in UTF-8 order. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    index, groups = postings(docs, text_col, lang_col, source_col, least_docs=least_docs)
    pair = pairs(index, groups).withColumn("rank", F.row_number().over(_places()))
    both = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, x in (("pair", pair), ("term", terms(index, ranked)))]
    return both[0].union(both[1])
