"""Line dedup: repeated runs of lines, by a suffix array over line ids that distributed prefix doubling sorts.

A document is the sequence of its lines' ids (64-bit hashes; blank lines are left out of the sequence). Lines that
occur once anywhere end any repeated run, so only stretches of repeated lines with enough words go on. Their suffixes
are ranked by their first line, then by pairs of ranks at distance 1, 2, 4 and so on: the rank after round k orders
suffixes by their first 2**k lines, and equal ranks are the suffix array's intervals of that common prefix. Sorting
stops at the depth that runs of ``min_words`` words need.

The runs asked for are, from each line on and up to each line, the shortest of at least ``min_words`` words. A run's
interval is named by the ranks of its two halves (which may overlap), so runs are equal when names are. Of each interval
the first run in order of (doc_id, line) stays and all others are marked; one that overlaps the first is marked from
the first one's end on. Each maximal repeated run is the union of the runs inside it, as these begin at its first line
and end at its last, so what is marked is every later copy of a maximal repeated run, whole. Intervals are aggregated
before any shuffle brings their members together, and stored before they are joined, so that a very common line or run
can be split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, small_batches, stored

MIN_WORDS = 50


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, q, line, h, words) of each line with a word: q counts those, line all lines."""
    for batch in batches:
        for part in K.chunks(batch, "text"):
            raw, off = K.text_bytes(part.column("text"))
            _, start, _, _ = K.word_hashes(raw, off)
            breaks = np.flatnonzero(raw == 10)
            # a text's lines begin where it begins and after each of its line breaks
            begin = np.concatenate((off[:-1], breaks + 1))
            text = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1))
            order = np.lexsort((begin, text))
            begin, text = begin[order], text[order]
            first = np.searchsorted(text, np.arange(len(off)))
            end = np.concatenate((begin[1:] - 1, [0]))[: len(begin)]
            end[first[1:] - 1] = off[1:]
            while True:  # line ends of other systems, and blanks at the end
                blank = (end > begin) & K.SPACE[raw[np.maximum(end - 1, 0)]] if len(raw) else np.zeros(len(end), bool)
                if not blank.any():
                    break
                end = end - blank
            words = np.searchsorted(start, end) - np.searchsorted(start, begin)
            line = np.arange(len(begin)) - np.repeat(first[:-1], np.diff(first))
            some = np.flatnonzero(words > 0)
            kept = np.searchsorted(text[some], np.arange(len(off)))
            q = np.arange(len(some)) - np.repeat(kept[:-1], np.diff(kept))
            take = pa.array(text[some])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("key").take(take), pa.array(q), pa.array(line[some]), K.as_i64(K.span_hashes(raw, begin[some], end[some])) if len(raw) else pa.array([], pa.int64()), pa.array(words[some])],
                names=["doc_id", "key", "q", "line", "h", "words"])


_LINES = "doc_id long, key long, q long, line long, h long, words long"
_STRETCH = "doc_id long, key long, part long, q long, line long, h long, lens array<long>"


def run_lengths(words: list[int], least: int) -> list[list[int]]:
    """Per line the lengths of runs that begin there: the shortest of ``least`` words from it on, and those that are the
    shortest up to some line."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    out: list[list[int]] = [[] for _ in words]
    stop = np.searchsorted(total, total[:-1] + least)
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1
    pairs = {(a, b) for a, b in enumerate(stop.tolist()) if b <= n} | {(a, b + 1) for b, a in enumerate(begin.tolist()) if a >= 0}
    for a, b in sorted(pairs):
        out[a].append(b - a)
    return out


def _stretches(least: int):
    """Rows sorted by (doc_id, key, part, q) with the lengths of the runs that begin at them."""
    names = ["doc_id", "key", "part", "q", "line", "h", "lens"]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.list_(pa.int64())])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def flush() -> None:
            for row, lens in zip(held, run_lengths([x[6] for x in held], least)):
                out.append((*row[:6], lens))
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*names[:6], "words"))):
                if row[:3] != now:
                    flush()
                    now = row[:3]
                held.append(row)
            yield batch_of(out)
            out.clear()
        flush()
        yield batch_of(out)

    return run


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with r: how many rows have a smaller (a, b). Also the stored table of ranks.

    Distinct pairs are counted first and dealt by ranges of (a, b), which Spark samples and of which there are as many
    as shuffle partitions: the followers of one very common line are split as any other pairs are. Each range is summed
    for itself, and ranges are joined by their totals.
    """
    counted = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = stored(counted.repartitionByRange("a", "b").withColumn("g", F.spark_partition_id()), "pairs")
    below = pairs.groupBy("g").agg(F.sum("n").alias("t")).select("g", (F.sum("t").over(Window.orderBy("g")) - F.col("t")).alias("base"))  # a row per range
    inside = Window.partitionBy("g").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    names = pairs.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(below), "g").select("a", "b", (F.col("base") + F.col("before")).alias("r"))
    return rows.join(names, ["a", "b"]), pairs


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, lines): the lines (numbers from 0, in order) of each document that repeat an earlier run.

    key is the text's 64-bit hash. A null doc_id comes before all others; rows of equal doc_id and text are one document.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    lines = stored(base.withColumn("key", F.xxhash64("text")).mapInArrow(_lines, _LINES), "lines")
    often = stored(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    own = Window.partitionBy("doc_id", "key").orderBy("q")
    rows = lines.join(often, "h").dropDuplicates(["doc_id", "key", "q"]).withColumn("part", F.col("q") - F.row_number().over(own))
    whole = rows.withColumn("all", F.sum("words").over(Window.partitionBy("doc_id", "key", "part"))).where(F.col("all") >= min_words)
    stretches = stored(whole.select("doc_id", "key", "part", "q", "line", "h", "words").sortWithinPartitions("doc_id", "key", "part", "q").mapInArrow(_stretches(min_words), _STRETCH), "stretches")
    discard(lines, often)
    longest = stretches.agg(F.max(F.array_max("lens"))).first()[0] or 0
    named: list[DataFrame] = []
    of = ("doc_id", "key", "part")
    suffixes = stretches.select(*of, F.struct("q", "line", "lens").alias("x"), F.col("h").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(longest.bit_length()):
        # a row per stretch: its suffixes in order, with their ranks
        rows, pairs = _ranked(suffixes)
        ranked = stored(rows.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("x.q", "x.line", "x.lens", "r"))).alias("s")), "suffixes")
        discard(pairs)
        # a run's name: the ranks of its first and its last 2**level lines
        names = F.expr(f"""inline(flatten(transform(s, (x, i) -> transform(filter(x.lens, n -> n >= {2**level} and n < {2 ** (level + 1)}),
            n -> named_struct('q', x.q, 'len', n, 'r1', x.r, 'r2', get(s, cast(i + n - {2**level} as int)).r, 'lines', transform(slice(s, i + 1, cast(n as int)), y -> y.line))))))""")
        named.append(ranked.select("doc_id", "key", names))
        # the pair of ranks at distance 2**level; past a stretch's end nothing repeats
        next_pair = F.expr(f"inline(transform(s, (x, i) -> named_struct('x', named_struct('q', x.q, 'line', x.line, 'lens', x.lens), 'a', x.r, 'b', coalesce(get(s, i + {2**level}).r, -1L))))")
        suffixes = ranked.select(*of, next_pair)
    if not named:
        return stretches.select("doc_id", "key", F.array("line").alias("lines")).limit(0)
    runs = reduce(DataFrame.union, named)
    place = F.struct("doc_id", "key", "q")
    first = stored(runs.groupBy("r1", "r2", "len").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = runs.join(first, ["r1", "r2", "len"]).where(place > F.col("first"))
    # lines that the first copy holds stay
    shared_lines = F.expr("case when doc_id = first.doc_id and key = first.key then greatest(0L, first.q + len - q) else 0L end").cast("int")
    rest = later.select("doc_id", "key", F.explode(F.slice("lines", shared_lines + 1, F.size("lines"))).alias("line"))
    return rest.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs of lines taken out of the texts, and the columns n_lines, n_deleted.

    Every row stays and keeps its other columns; a null text stays null. Runs under ``min_words`` words stay, and so
    does the first copy of each run, by (doc_id, line), but for lines that belong to a later copy of another run. Rows of
    equal doc_id and text are one document, so repeated rows lose the same lines; a null doc_id comes before all others.
    Input columns named n_lines or n_deleted are replaced; any other names may stand beside. An empty table gives an
    empty result.
    """
    gone = later_copies(docs, id_col, text_col, min_words=min_words).select("doc_id", "key", F.col("lines").alias("gone"))
    of = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row").getField(text_col)
    of = of.select("row", F.coalesce(F.col("row").getField(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("key"))
    out = of.join(gone, ["doc_id", "key"], "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long")), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at(lines, (i + 1).cast("int"))), "\n")
    made = {
        text_col: F.when(F.col("gone").isNull(), text).otherwise(kept),
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_deleted": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
    }
    names = [*docs.columns, *(c for c in ("n_lines", "n_deleted") if c not in docs.columns)]
    return out.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in names])
