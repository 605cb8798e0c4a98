"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation.

Every training text is gathered twice. First words are counted, exactly and all of them, into a table that grows with
the corpus. Then the neural model is trained over all training tokens, once: a hash of its text deals every training
row to one of ROUNDS rounds and, within it, to one of a number of parts that follows from the count of tokens alone.
The parts of a round start from the same parameters, take their rows in the order of the hash, and are averaged by
tokens, with the state of the step sizes; the next round goes on from there. So how a table lies in partitions and how
many tasks run has no bearing on the scores.

The model predicts one of the outputs: the most frequent words (4,095, twice as many for each fourfold of 2**24 tokens,
65,535 at most), the text's end, and for all other words a class by their first two bytes. The prediction vector is
c1 * r[a] + c2 * r[b] + f[k]: a and b are the last two words before the token that are among the ``FREQUENT`` most
frequent ones (however far back in the text), k says what kind of token stands directly before. As contexts are that
few, one batched matrix product gives all normalisers, so probabilities are normalised exactly. Within a class of other
words, P(word) = (c + 1) / (sum of (c + 1) over the class + 1), where the last 1 is for all words that the training texts
lack.

Counts of the most frequent ``HEAD`` words are broadcast (a bound of 9 MB); counts of all others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import stored, text_column

HEAD = 1 << 18
CLASSES = 128  # outputs for all other words
FREQUENT = 255
KINDS = 4
DIM = 16
NOISE = 32
ROUNDS = 6
#: Training tokens of a part where there is one part a round; parts grow with the square root of the tokens.
PART_TOKENS = 1 << 18
CONTEXTS = (FREQUENT + 1) ** 2 * KINDS


def named_words(tokens: int) -> int:
    """How many words have outputs of their own."""
    return 2 ** min(16, max(12, 12 + (max(1, tokens).bit_length() - 25) // 2)) - 1


def parts_of_round(tokens: int, rounds: int = ROUNDS) -> int:
    return max(1, math.ceil(4 * math.sqrt(tokens / (rounds * PART_TOKENS)) - 1))


@dataclass
class Vocabulary:
    """The head's word hashes (sorted), their counts and output classes, and corpus totals."""

    hashes: np.ndarray
    counts: np.ndarray
    output: np.ndarray  # below ``words`` for a word of its own, else any larger number
    frequent: np.ndarray  # 1..FREQUENT for the most frequent words, else 0
    mass: np.ndarray  # per class of other words
    output_counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    @property
    def words(self) -> int:
        """How many words have outputs of their own; the next output is the text's end, then the classes follow."""
        return len(self.output_counts) - CLASSES - 1


def word_class(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """0..CLASSES-1 from a word's first two bytes."""
    b0 = K.LOWER[data[start]].astype(np.int64)
    b1 = np.where(end - start > 1, K.LOWER[data[np.minimum(start + 1, max(len(data) - 1, 0))]], 0) if len(start) else b0
    return (b0 * 167 + b1 * 31) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        h, n, g = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        own, first, where = np.unique(h, return_index=True, return_inverse=True)
        held[:] = [(own, np.bincount(where, n, len(own)).astype(np.int64), g[first])]
        return pa.RecordBatch.from_arrays([K.as_i64(own), pa.array(g[first].astype(np.int32)), pa.array(held[0][1])], names=["h", "g", "c"])

    size = 0
    for batch in batches:
        for part in K.chunks(batch, "text"):
            raw, off = K.text_bytes(part.column("text"))
            words, start, end, _ = K.word_hashes(raw, off)
            own, first, n = np.unique(words, return_index=True, return_counts=True)
            held.append((own, n, word_class(raw, start[first], end[first])))
            size += len(own)
            if size > 3_000_000:
                done = merged()
                size = done.num_rows
                if size > 1_500_000:
                    yield done
                    held.clear()
                    size = 0
    yield merged()


@dataclass
class Parameters:
    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    f: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c, self.f, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        outputs = (len(flat) - (FREQUENT + 3 + KINDS) * DIM) // (DIM + 1)
        shapes = [(FREQUENT + 1, DIM), (outputs, DIM), (2, DIM), (KINDS, DIM), (outputs,)]
        out, at = [], 0
        for shape in shapes:
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape).astype(np.float32).copy())
            at += n
        return Parameters(*out)

    @staticmethod
    def start(output_counts: np.ndarray) -> Parameters:
        rng = np.random.default_rng(5)
        share = (output_counts + 1) / (output_counts + 1).sum()
        draw = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
        return Parameters(draw(FREQUENT + 1, DIM), draw(len(share), DIM), np.ones((2, DIM), np.float32), draw(KINDS, DIM), np.log(share).astype(np.float32))

    def predictions(self, contexts: np.ndarray) -> np.ndarray:
        a, b, k = contexts // ((FREQUENT + 1) * KINDS), contexts // KINDS % (FREQUENT + 1), contexts % KINDS
        return self.c[0] * self.r[a] + self.c[1] * self.r[b] + self.f[k]

    def log_normalisers(self, contexts: np.ndarray) -> np.ndarray:
        out = np.empty(len(contexts), np.float32)
        step = max(1, (4 << 20) // len(self.q))
        for i in range(0, len(contexts), step):
            s = self.predictions(contexts[i : i + step]) @ self.q.T
            s += self.bias
            top = s.max(axis=1)
            s -= top[:, None]
            out[i : i + step] = top + np.log(np.exp(s, out=s).sum(axis=1))
        return out


@dataclass
class Tokens:
    """The tokens of a chunk of texts, text ends included."""

    hashes: np.ndarray  # 0 at ends
    place: np.ndarray  # in the vocabulary's head, or -1
    output: np.ndarray
    context: np.ndarray
    bounds: np.ndarray


def tokens(column: pa.Array, v: Vocabulary) -> Tokens:
    raw, off = K.text_bytes(column)
    words, start, end, first = K.word_hashes(raw, off)
    texts = len(off) - 1
    bounds = first + np.arange(texts + 1)
    total = len(words) + texts
    at_word = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(first))
    hashes = np.zeros(total, np.uint64)
    hashes[at_word] = words
    place = np.full(total, -1, np.int64)
    output = np.full(total, v.words, np.int64)
    frequent = np.zeros(total, np.int64)
    kind = np.zeros(total, np.int64)
    if len(words):
        near = np.minimum(np.searchsorted(v.hashes, words), max(len(v.hashes) - 1, 0))
        hit = v.hashes[near] == words if len(v.hashes) else np.zeros(len(words), bool)
        place[at_word] = np.where(hit, near, -1)
        own = np.where(hit, v.output[near] if len(v.hashes) else 0, v.words)
        own = np.where(own < v.words, own, v.words + 1 + word_class(raw, start, end))
        output[at_word] = own
        frequent[at_word] = np.where(hit, v.frequent[near] if len(v.hashes) else 0, 0)
        kind[at_word] = np.where(frequent[at_word] > 0, 1, np.where(own < v.words, 2, 3))
    where = np.arange(total)
    low = np.repeat(bounds[:-1], np.diff(bounds))
    last = np.maximum.accumulate(np.where(frequent > 0, where, -1)) if total else where
    before = np.concatenate(([-1], last[:-1])) if total else last
    second = np.where(before >= 0, before[np.maximum(before, 0)], -1)
    a = np.where(before >= low, frequent[np.maximum(before, 0)], 0)
    b = np.where((before >= low) & (second >= low), frequent[np.maximum(second, 0)], 0)
    k = np.concatenate(([0], kind[:-1])) if total else kind
    k = np.where(where == low, 0, k)
    return Tokens(hashes, place, output, (a * (FREQUENT + 1) + b) * KINDS + k, bounds)


_DIMS = np.arange(DIM)


def _summed(places: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(size, DIM): the sums of the rows at each place."""
    return np.bincount((places[:, None] * DIM + _DIMS).ravel(), rows.ravel(), size * DIM).reshape(size, DIM).astype(np.float32)


class Trainer:
    """AdaGrad over noise-contrastive estimation in mini-batches with shared noise; only the drawn outputs move."""

    def __init__(self, parameters: Parameters, output_counts: np.ndarray, rate: float = 0.1, seed: int = 1, squares: Parameters | None = None):
        self.p, self.rate = parameters, rate
        share = (output_counts + 1) / (output_counts + 1).sum()
        self.cumulative, self.log_noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        self.squares = squares or Parameters(*(np.full(x.shape, 0.1, np.float32) for x in parameters.arrays()))
        self.rng = np.random.default_rng(seed)

    def step(self, contexts: np.ndarray, outputs: np.ndarray) -> None:
        p, n = self.p, len(outputs)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(p.q) - 1)
        a, b, k = contexts // ((FREQUENT + 1) * KINDS), contexts // KINDS % (FREQUENT + 1), contexts % KINDS
        pred = p.c[0] * p.r.take(a, axis=0) + p.c[1] * p.r.take(b, axis=0) + p.f.take(k, axis=0)
        own, drawn = p.q.take(outputs, axis=0), p.q.take(noise, axis=0)
        s = np.einsum("ij,ij->i", pred, own) + p.bias[outputs] - self.log_noise[outputs]
        t = pred @ drawn.T + (p.bias[noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(s, -30, 30)))  # 1 - sigmoid
        down = 1 / (1 + np.exp(np.clip(-t, -30, 30)))
        d_pred = up[:, None] * own - down @ drawn
        names, where = np.unique(np.concatenate((outputs, noise)), return_inverse=True)
        g_q = _summed(where, np.concatenate((up[:, None] * pred, -(down.T @ pred))), len(names))
        g_bias = np.bincount(where, np.concatenate((up, -down.sum(axis=0))), len(names)).astype(np.float32)
        # sums by word, then over words: the two places before share one table
        g = [_summed(of, d_pred, FREQUENT + 1) for of in (a, b)]
        d_c = np.stack([(x * p.r).sum(axis=0) for x in g])
        d_r = g[0] * p.c[0] + g[1] * p.c[1]
        d_f = _summed(k, d_pred, KINDS)
        every = slice(None)
        for x, square, g, rows_of in zip(p.arrays(), self.squares.arrays(), (d_r, g_q, d_c, d_f, g_bias), (every, names, every, every, names)):
            g /= np.float32(n) ** np.float32(0.5)
            square[rows_of] += g * g
            x[rows_of] += self.rate * g / np.sqrt(square[rows_of])


def _head(counts: DataFrame) -> DataFrame:
    """The HEAD most frequent words, or all: whole levels of counts, and of the level at the edge those of the smallest
    hash classes."""
    level = F.floor(F.log2("c") * 64)
    levels = counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("l")).collect()  # about 64 per power of two
    total = 0
    for row in levels:
        if total + row.n > HEAD:
            spread = F.pmod(F.xxhash64("h"), F.lit(1 << 16))
            classes = counts.where(level == row.l).groupBy(spread.alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()  # 65,536 rows at most
            edge = 0
            for c in classes:
                total += c.n
                if total > HEAD:
                    break
                edge = c.s + 1
            return counts.where((level > row.l) | ((level == row.l) & (spread < edge)))
        total += row.n
    return counts


def _vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    totals = counts.agg(F.sum("c").alias("c"), F.count("*").alias("n")).first()
    tokens = int((totals.c or 0) + ends)
    words = named_words(tokens)
    head = _head(counts).toArrow()
    h, c = np.asarray(head.column("h")).view(np.uint64), np.asarray(head.column("c"))
    order = np.lexsort((h, -c))
    output, frequent = np.full(len(h), words, np.int64), np.zeros(len(h), np.int64)
    named = order[:words]
    output[named] = np.arange(len(named))
    frequent[order[:FREQUENT]] = np.arange(1, min(FREQUENT, len(h)) + 1)
    output_counts = np.zeros(words + 1 + CLASSES, np.int64)
    output_counts[: len(named)] = c[named]
    output_counts[words] = ends
    classes = np.asarray(head.column("g"))[named]
    mass = np.ones(CLASSES)
    for row in counts.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # CLASSES rows
        others = int(row.c - c[named][classes == row.g].sum())
        output_counts[words + 1 + row.g] = others
        mass[row.g] += others + row.n - (classes == row.g).sum()
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], c[by_hash], output[by_hash], frequent[by_hash], mass, output_counts, tokens, int(totals.n + (ends > 0)), ends)


def _named(v: Vocabulary) -> Vocabulary:
    """The part of the head that has outputs of its own: enough to train, and small."""
    own = v.output < v.words
    return replace(v, hashes=v.hashes[own], counts=v.counts[own], output=v.output[own], frequent=v.frequent[own])


def _averaged(rows: DataFrame, parts: int, fan: int = 16) -> np.ndarray | None:
    """The mean of state vectors (part, n, p) by tokens, in the order of parts; parts meet in groups of ``fan`` until
    so many are left."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, total = None, 0, None

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["part", "n", "p"])

        for batch in batches:
            for part, k, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "p"))):
                if group is not None and part // fan != group:
                    yield whole()
                    n, total = 0, None
                x = np.frombuffer(raw, np.float32).astype(np.float64) * k
                group, n, total = part // fan, n + k, x if total is None else total + x
        if n:
            yield whole()

    while parts > fan:
        rows = rows.withColumn("g", F.expr(f"part div {fan}")).repartition(-(-parts // fan), "g").sortWithinPartitions("part").select("part", "n", "p").mapInArrow(add, "part long, n long, p binary")
        parts = -(-parts // fan)
    found = sorted(rows.collect(), key=lambda r: r.part)  # ``fan`` vectors at most
    n = sum(r.n for r in found)
    return sum(np.frombuffer(r.p, np.float32).astype(np.float64) * (r.n / n) for r in found) if n else None


def passes(tokens: int) -> int:
    """How often each chunk of training text is taken: more than once in small corpora, which have too few steps."""
    return min(4, 1 + (1 << 21) // max(1, tokens))


def dealt_rows(learn: DataFrame, parts: int) -> DataFrame:
    """(h, text, part) of rows (doc_id, text): dealt by a hash of both, so that copies of one text spread over all parts."""
    return learn.select(F.xxhash64("doc_id", "text").alias("h"), "text").withColumn("part", F.expr(f"pmod(h, {parts})"))


def train(learn: DataFrame, v: Vocabulary, rounds: int = ROUNDS, batch_tokens: int = 1024) -> Parameters:
    """Parameters from all rows of ``learn`` (doc_id, text), whatever its partitions."""
    spark = learn.sparkSession
    p = Parameters.start(v.output_counts)
    squares = Parameters(*(np.full(x.shape, 0.1, np.float32) for x in p.arrays()))
    parts = parts_of_round(v.tokens, rounds)
    dealt = dealt_rows(learn, rounds * parts)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((_named(v), p.flat(), squares.flat()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, flat, state = sent.value
            part, seen, trainer = None, 0, None

            def whole() -> pa.RecordBatch:
                made = np.concatenate((trainer.p.flat(), trainer.squares.flat())).astype(np.float32)
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([made.tobytes()], pa.binary())], names=["part", "n", "p"])

            for batch in batches:
                parts_in = np.asarray(batch.column("part"))
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(parts_in)) + 1, [len(parts_in)])) if len(parts_in) else [0]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if parts_in[a] != part:
                        if seen:
                            yield whole()
                        part, seen = int(parts_in[a]), 0
                        trainer = Trainer(Parameters.of(flat), vocabulary.output_counts, seed=part, squares=Parameters.of(state))
                    for chunk in K.chunks(batch.slice(a, b - a), "text"):
                        t = tokens(chunk.column("text"), vocabulary)
                        for _ in range(passes(vocabulary.tokens)):
                            order = trainer.rng.permutation(len(t.output))
                            for i in range(0, len(order), batch_tokens):
                                pick = order[i : i + batch_tokens]
                                trainer.step(t.context[pick], t.output[pick])
                        seen += len(t.output)
            if seen:
                yield whole()

        own = dealt.where(F.expr(f"part div {parts} = {r}")).withColumn("part", F.expr(f"part % {parts}"))
        rows = own.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "h", "text").select("part", "text").mapInArrow(run, "part long, n long, p binary")
        mean = _averaged(rows, parts)
        sent.destroy()
        if mean is not None:
            half = len(mean) // 2
            p, squares = Parameters.of(mean[:half]), Parameters.of(mean[half:])
    return p


def _normalisers(spark, p: Parameters) -> np.ndarray:
    sent = spark.sparkContext.broadcast(p.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Parameters.of(sent.value)
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.log_normalisers(ids))], names=["id", "z"])

    table = spark.range(0, CONTEXTS, 1, 32).mapInArrow(run, "id long, z float").toArrow()
    out = np.empty(CONTEXTS, np.float32)
    out[np.asarray(table.column("id"))] = np.asarray(table.column("z"))
    sent.destroy()
    return out


def _score(sent):
    """A row per text (n = 0, h a value that stands for nothing) and one per other word of it (n > 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat, z = sent.value
        p = Parameters.of(flat)
        pred = p.predictions(np.arange(CONTEXTS))
        base = np.log10(v.counts + 1.0)
        floor = np.log10(v.tokens + v.distinct + 1.0)
        log_mass = np.log10(v.mass)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                t = tokens(part.column("text"), v)
                first = t.bounds[:-1]
                texts = len(first)
                if not texts:
                    continue
                end = t.hashes == 0
                end &= t.output == v.words
                count = np.zeros(len(t.output))
                known = t.place >= 0
                count[known] = base[t.place[known]]
                count[end] = np.log10(v.ends + 1.0)
                logp = np.empty(len(t.output))
                for i in range(0, len(logp), 65536):
                    c, o = t.context[i : i + 65536], t.output[i : i + 65536]
                    logp[i : i + 65536] = (np.einsum("ij,ij->i", pred[c], p.q[o]) + p.bias[o] - z[c]) / np.log(10)
                other = t.output > v.words
                logp[other] += count[other] - log_mass[t.output[other] - v.words - 1]
                add = lambda x: np.add.reduceat(x, first)
                n = np.diff(t.bounds)
                text_of = np.repeat(np.arange(texts), n)
                tail = np.flatnonzero(~known & ~end)
                pair = K.mix(t.hashes[tail] ^ K.mix(text_of[tail].astype(np.uint64)))
                _, at, times = np.unique(pair, return_index=True, return_counts=True)
                at = tail[at]
                ids, keys = part.column("doc_id"), part.column("key")
                back = pa.array(text_of[at])
                rest = pa.nulls(len(at), pa.float64())
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([ids, ids.take(back)]),
                    pa.concat_arrays([keys, keys.take(back)]),
                    pa.concat_arrays([keys, K.as_i64(t.hashes[at])]),
                    pa.array(np.concatenate((np.zeros(texts, np.int64), times)), pa.int64()),
                    pa.concat_arrays([pa.array(n.astype(np.float64)), rest]),
                    pa.concat_arrays([pa.array(add((known | (end & (v.ends > 0))).astype(np.float64))), rest]),
                    pa.concat_arrays([pa.array(add(count) - n * floor), rest]),
                    pa.concat_arrays([pa.array(add(logp)), rest]),
                ], names=["doc_id", "key", "h", "n", "tokens", "known", "base", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, parts: int = 7, held: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Learns from rows whose crc32(doc_id as text) mod ``parts`` is not ``held``. A null or empty text is one token, its
    end. Rows without a doc_id are scored (held_out null) but teach nothing; repeated rows each count and each return.
    Without training rows all counts are zero.
    """
    spark = docs.sparkSession
    base = text_column(docs, id_col, text_col)
    fold = F.crc32(F.col("doc_id").cast("string")) % parts == held
    learn = base.where(~fold)
    ends = learn.select("doc_id").count()
    counts = stored(learn.select("text").mapInArrow(_count, "h long, g int, c long").groupBy("h", "g").agg(F.sum("c").alias("c")), "counts")
    v = _vocabulary(counts, ends)
    p = train(learn.select("doc_id", "text"), v, rounds)
    sent = spark.sparkContext.broadcast((v, p.flat(), _normalisers(spark, p)))
    rows = base.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(
        _score(sent), "doc_id long, key long, h long, n long, tokens double, known double, base double, score double")
    seen = rows.join(counts.select("h", "c"), "h", "left")
    more = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    whole = seen.groupBy("doc_id", "key").agg(
        F.count("tokens").alias("rows"), F.max("tokens").alias("tokens"), F.max("known").alias("known"), F.max("base").alias("base"), F.max("score").alias("score"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("also"), F.sum(more).alias("more"))
    each = whole.select("*", F.explode(F.expr("sequence(1L, rows)")).alias("_row"))
    return each.select(
        "doc_id", fold.alias("held_out"), F.col("tokens").cast("long").alias("n_tokens"), (F.col("known") + F.col("also") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("more") / F.col("rows")).alias("base_score"), (F.col("score") + F.col("more") / F.col("rows")).alias("score"))
