"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are folded to bytes: A-Z and Latin-1 capitals in lower case, runs of anything but letters and digits as
one space. An item of m bytes may be k = rate * m edits away. It is split in k + 1 pieces, one of which any match holds
unchanged; an Aho-Corasick automaton finds all piece hits in one pass over the texts. Pieces are paired: as k edits can't spoil
every pair twice, some unchanged piece has a partner with one edit at most, so a hit goes on only if one half of its
partner stands beside it, shifted by one at most. Around what is left the item's 5-grams are counted (k edits spoil at
most 5 k of them), and the rest is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import small_batches, stored, text_column

RATE = 0.1
#: Benchmark text sent to executors at once; more items go in further passes.
BLOCK_BYTES = 8 << 20
_GRAM = 5

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, offsets, place of each folded byte in raw); texts neither begin nor end with a space."""
    if not len(raw):
        return raw, np.zeros(len(off), np.int64), np.empty(0, np.int64)
    x = _FOLD[raw]
    capital = np.zeros(len(raw), bool)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    x[capital] += 32
    space = x == 32
    edge = np.zeros(len(raw), bool)  # a text's first byte
    edge[off[:-1][off[:-1] < len(raw)]] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & ~edge[1:]
    at = np.flatnonzero(keep)
    bounds = np.searchsorted(at, off)
    # a space that ends its text goes
    tail = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    tail = tail[x[at[tail]] == 32]
    at = np.delete(at, tail)
    return x[at], np.searchsorted(at, off), at


def folded_text(text: str) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    return fold(raw, np.array([0, len(raw)]))[0].tobytes().decode("latin-1")


class Item:
    """A test item: its folded text, error budget, pieces and bit masks."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.item_id, self.text, self.m = item_id, text, len(text)
        self.k = int(rate * self.m)
        cuts = [round(j * self.m / (self.k + 1)) for j in range(self.k + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        self.grams = {text[i : i + _GRAM] for i in range(self.m - _GRAM + 1)}
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, window: str) -> tuple[int, int]:
        """(distance, end) of the item's best match anywhere in the window: Myers' algorithm, first end of the least."""
        plus, minus, score = self.full, 0, self.m
        least, end = self.m, 0
        masks, full, top = self.masks, self.full, self.top
        for j, c in enumerate(window, 1):
            eq = masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            plus = mh | (full & ~(xv | ph))
            minus = ph & xv
            if score < least:
                least, end = score, j
        return least, end

    def match(self, window: str) -> tuple[int, int, int] | None:
        """(distance, start, end) within the window if within the budget."""
        if self.k:
            if sum(g in self.grams for g in {window[i : i + _GRAM] for i in range(len(window) - _GRAM + 1)}) < len(self.grams) - _GRAM * self.k:
                return None
        distance, end = self.best(window)
        if distance > self.k:
            return None
        back = Item.__new__(Item)
        back.text, back.m = self.text[::-1], self.m
        back.masks = {c: int(f"{v:0{self.m}b}"[::-1], 2) for c, v in self.masks.items()}
        back.full, back.top = self.full, self.top
        _, length = back.best(window[max(0, end - self.m - self.k) : end][::-1])
        return distance, end - length, end


def _matcher(items: list[Item]) -> ahocorasick.Automaton:
    """Pieces with (length, [(item, place in the item, partner)]); a partner is (is it on the right, its halves)."""
    out = ahocorasick.Automaton()
    places: dict[str, list[tuple]] = {}
    for i, item in enumerate(items):
        for j, (at, piece) in enumerate(item.pieces):
            partner = None
            if j ^ 1 < len(item.pieces):
                text = item.pieces[j ^ 1][1]
                partner = (j % 2 == 0, text[: len(text) // 2], text[len(text) // 2 :])
            places.setdefault(piece, []).append((i, at, partner))
    for piece, where in places.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out


def _beside(text: str, begin: int, end: int, partner: tuple[bool, str, str]) -> bool:
    """Whether a half of the partner stands where it should beside text[begin:end], or one place off."""
    right, a, b = partner
    n, m = len(a), len(b)
    if right:
        return a in text[max(0, end - 1) : end + n + 1] or b in text[max(0, end + n - 1) : end + n + m + 1]
    return b in text[max(0, begin - m - 1) : begin + 1] or a in text[max(0, begin - m - n - 1) : max(0, begin - m + 1)]


#: The block that this worker last matched with: a name, its items and their automaton.
_kept: tuple[str, list[Item], ahocorasick.Automaton] | None = None


def _made(name: str, sent, rate: float) -> tuple[list[Item], ahocorasick.Automaton]:
    """The block's items and automaton, made once a worker and not once a task; a worker holds one block at a time."""
    global _kept
    if _kept is None or _kept[0] != name:
        _kept = None
        items = [Item(i, t, rate) for i, t in sent.value]
        _kept = name, items, _matcher(items)
    return _kept[1:]


def _find(sent, rate: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, automaton = _made(name, sent, rate)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                raw, off = K.text_bytes(part.column("text"))
                folded, bounds, place = fold(raw, off)
                # one scan over all texts of the chunk; a piece that two texts make together is told by its place
                text = folded.tobytes().decode("latin-1")
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                ids = part.column("doc_id").to_pylist()
                found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                tried: dict[tuple[int, int], list[int]] = {}
                row = 0
                for last, (length, where) in automaton.iter(text) if items else ():
                    begin = last - length + 1
                    while last >= bounds[row + 1]:
                        row += 1
                    if begin < bounds[row]:
                        continue
                    for i, at, partner in where:
                        if partner and not _beside(text, begin, last + 1, partner):
                            continue
                        item = items[i]
                        start = begin - at
                        seen = tried.setdefault((row, i), [])
                        if any(abs(start - s) <= item.k // 2 for s in seen[-3:]):
                            continue
                        seen.append(start)
                        lo, hi = max(int(bounds[row]), start - item.k - item.k // 2), min(int(bounds[row + 1]), start + item.m + item.k + item.k // 2)
                        hit = item.match(text[lo:hi])
                        if hit:
                            found.setdefault((row, i), []).append((hit[0], lo + hit[1], lo + hit[2]))
                rows: list[tuple] = []
                for (r, i), hits in found.items():
                    hits.sort()
                    taken: list[tuple[int, int]] = []
                    for distance, a, b in hits:
                        if all(b <= x or a >= y for x, y in taken):
                            taken.append((a, b))
                            base = points[off[r]]
                            rows.append((ids[r], items[i].item_id, distance, int(points[place[a]] - base), int(points[place[b - 1]] - base) + 1))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "start", "stop"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The folded items in blocks of bounded size, read one after the other."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null").distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        text = folded_text(row.t)
        if text:
            block.append((row.i, text))
            size += len(text)
            if size >= block_bytes:
                yield block
                block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", *, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start, stop: each place where a text holds a test item within its error budget.

    distance counts edits of folded bytes; start and stop are code points of the text, stop exclusive. Of overlapping
    matches of one item the nearest is given. Items and texts that are null or hold no letter or digit match nothing;
    items under 10 folded bytes have no room for an edit. Repeated rows each give their matches; empty tables give none.
    """
    base = text_column(docs, id_col, text_col)
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, text_col, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], _MATCH)
    if second is None:
        return base.mapInArrow(_find(spark.sparkContext.broadcast(first), rate), _MATCH)
    made = []
    # one block after the other is in the driver's and the executors' memory; matches are written block by block
    for block in chain((first, second), blocks):
        sent = spark.sparkContext.broadcast(block)
        made.append(stored(base.mapInArrow(_find(sent, rate), _MATCH), "matches"))
        sent.destroy()
    return reduce(DataFrame.union, made)


_MATCH = "doc_id long, item_id long, distance long, start long, stop long"


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs whose text holds no test item.

    Items of one block are looked for where the rows are. With more blocks, texts are named by their hash, each
    block's finds are written, and the rows found go in one join at the end.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rate = parameters.get("rate", RATE)
    blocks = _blocks(benchmark, parameters.get("item_col", "item_id"), "text", parameters.get("block_bytes", BLOCK_BYTES))
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        find = _find(spark.sparkContext.broadcast(first), rate)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in K.chunks(batch, text_col):
                    numbered = pa.RecordBatch.from_arrays([pa.array(range(part.num_rows), pa.int64()), part.column(text_col)], names=["doc_id", "text"])
                    clean = np.ones(part.num_rows, bool)
                    for hits in find(iter([numbered])):
                        clean[np.asarray(hits.column("doc_id"))] = False
                    yield part.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)
    key = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    texts = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = []
    for block in chain((first, second), blocks):
        sent = spark.sparkContext.broadcast(block)
        found.append(stored(texts.mapInArrow(_find(sent, rate), _MATCH).select("doc_id").distinct(), "found"))
        sent.destroy()
    away = reduce(DataFrame.union, found).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("doc_id"))
    return rows.join(away, "doc_id", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
