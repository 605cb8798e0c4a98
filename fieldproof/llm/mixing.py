"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree over output shards.

Each source's documents stand on a line in the order of a hash, and the words that the mix takes of it, its target, are
the line read from its beginning, once more from there where the target is more than the source holds. That stream is
cut into blocks of equal words; the count of blocks is the source's quota. The tree's root holds all quotas and all
shards. A node halves its shards and draws how many blocks of each source go left, as if the node's blocks were
shuffled and dealt: source by source from a hypergeometric distribution, given what is left of the draws. So quotas are
kept exactly, shards hold equal numbers of blocks (one apart at most), and the composition of a shard is that of a
shuffle of everything, without one. Each leaf owns a range of every source's permuted blocks, disjoint from all others;
a block's place in that order comes from a keyed permutation of its number, so nothing is sorted to draw it. What a
shard drew is shuffled within the shard.

Everything is DataFrame and SQL functions. Draws are hashes of (seed, node, source), so reruns agree. A line is numbered
in as many parts as the square root of its rows, so a hot source is never one task. A row of the tree holds the quotas
of the sources that still have blocks there: as many numbers as there are sources at the root, which is what bounds it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stored

WEIGHTS = (5, 2, 1)
#: The mix takes so many parts of all words, by halves: 3 halves are 150 %.
HALVES = 3
#: A source is read so often at most.
PASSES = 2
BLOCK_WORDS, SHARD_BLOCKS = 4096, 1024
#: Ranges in which sources are numbered.
RANGES = 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(doc_id, source, size, h, g) per row: size in words, and two hashes that order a source's line."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    doc_id, source = F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").cast("string")
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), doc_id, text).alias("h"), F.xxhash64(F.lit(seed + 1), text, doc_id).alias("g"))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with ``number``, from 0 in order of code points, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stored(sources.repartitionByRange(RANGES, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("place", place).join(starts, "range").withColumn("number", F.col("first") + F.col("place") - 1).drop("range", "place", "first")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES, passes: int = PASSES) -> DataFrame:
    """(source, number, source_size, rows, weight, target, words), stored: words is the target as a whole number.

    A level per unit of weight rises: sources whose share passes ``passes`` times their size stop there, and the rest is
    shared anew by weight, until none is above. Each round is one aggregate, exact in decimals, over a row per source.
    """
    found = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    every = stored(found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))), "mix-sources")
    whole = lambda x: F.lit(Decimal(x)).cast("decimal(38, 0)")
    cap = F.col("source_size").cast("decimal(25, 0)") * passes
    above: Column = F.lit(False)
    stopped, up, down = -1, 0, 1
    while True:
        row = every.agg(F.sum("source_size").alias("size"), F.sum(F.when(above, cap).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        if row["n"] == stopped or not row["weight"]:
            break
        stopped = row["n"]
        up, down = halves * int(row["size"]) - 2 * int(row["held"]), 2 * int(row["weight"])
        above = F.col("weight") * whole(up) > cap * whole(down)
    share = F.col("weight") * whole(up)
    words = F.expr(f"cast((2 * weight * cast({up} as decimal(30, 0)) + {down}) div cast({2 * down} as decimal(30, 0)) as long)")
    out = every.select(
        "source", "number", "source_size", "rows", "weight", F.when(above, cap.cast("double")).otherwise(share.cast("double") / F.lit(float(down))).alias("target"),
        F.when(above, F.col("source_size") * passes).otherwise(words).alias("words"))
    return stored(out, "mix-targets")


def line(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with number, part, place and start, stored: the word at which each begins on its source's line.

    A source's line has 2**bits parts of its hash order, about the square root of its rows.
    """
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    small = goals.select(F.col("source").alias("goal_source"), "number", F.ceil(F.log2(F.col("rows")) / 2).cast("int").alias("bits"))
    part = F.expr("if(bits = 0, 0L, shiftrightunsigned(h, 64 - bits))")
    placed = stored(rows.join(small, same).select("doc_id", "source", "size", "number", part.alias("part"), "h", "g"), "mix-parts")
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("number", "part").agg(F.sum("size").alias("words")).select("number", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("number", "part").orderBy("h", "g", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(parts, ["number", "part"]).withColumn("place", F.row_number().over(order)).withColumn("start", F.col("first") + inside).drop("first", "h", "g")
    out = stored(out, "mix-line")
    discard(placed)
    return out


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many of ``drawn`` balls out of ``total`` are among the ``marked`` ones, by inversion at ``u`` in (0, 1].

    Weights follow from each other by their ratio, over all values within ten standard deviations and ten of the mode;
    what lies beyond them is under e**-50 of the whole.
    """
    ratio = "(cast(p.m - x as double) * (p.n - x) / (cast(x + 1 as double) * (p.t - p.m - p.n + x + 1)))"
    walk = f"aggregate(r, named_struct('w', 1D, 'sum', 0D), (s, x) -> named_struct('w', s.w * {ratio}, 'sum', s.sum + s.w), s -> s.sum)"
    pick = f"aggregate(r, named_struct('w', 1D, 'left', p.u * {walk}, 'at', r[0]), (s, x) -> named_struct('w', s.w * {ratio}, 'left', s.left - s.w, 'at', if(s.left > 0, x, s.at)), s -> s.at)"
    low, high = "greatest(0L, p.n + p.m - p.t)", "least(p.m, p.n)"
    mode = "cast(floor((p.n + 1D) * (p.m + 1D) / (p.t + 2D)) as long)"
    spread = "cast(10 * sqrt(greatest(0D, cast(p.n as double) * p.m / p.t * (1 - cast(p.m as double) / p.t) * (p.t - p.n) / greatest(1L, p.t - 1))) + 10 as long)"
    span = _let("c", f"named_struct('mode', least({high}, greatest({low}, {mode})), 'spread', {spread})", f"sequence(greatest({low}, c.mode - c.spread), least({high}, c.mode + c.spread))")
    return _let("p", f"named_struct('t', {total}, 'm', {marked}, 'n', {drawn}, 'u', {u})", f"if(p.t = 0, 0L, {_let('r', span, pick)})")


def _halved(nodes: DataFrame, blocks: int, shards: int, seed: int) -> DataFrame:
    """The tree's next level: nodes of more than one shard give two."""
    border = lambda j: f"cast(cast({j} as decimal(19, 0)) * {blocks} div {shards} as long)"
    u = f"(shiftrightunsigned(xxhash64({seed}L, first, n_shards, v.number), 11) + 1) * {2.0**-53!r}D"
    # v.start and v.quota: the range of the source's permuted blocks that the node owns
    left = f"""aggregate(quotas, named_struct('t', blocks, 'n', go, 'out', cast(array() as array<struct<number: long, of: long, start: long, quota: long, left: long>>)),
        (acc, v) -> {_let('k', hypergeometric('acc.t', 'v.quota', 'acc.n', u), "named_struct('t', acc.t - v.quota, 'n', acc.n - k, 'out', concat(acc.out, array(named_struct('number', v.number, 'of', v.of, 'start', v.start, 'quota', v.quota, 'left', k))))")},
        acc -> acc.out)"""
    split = nodes.withColumn("half", F.expr("n_shards div 2")).withColumn("go", F.expr(f"{border('first + half')} - {border('first')}")).withColumn("dealt", F.expr(f"if(n_shards = 1, cast(null as array<struct<number: long, of: long, start: long, quota: long, left: long>>), {left})"))
    side = lambda first, n, count, start, quota: f"named_struct('first', {first}, 'n_shards', {n}, 'blocks', {count}, 'quotas', filter(transform(dealt, v -> named_struct('number', v.number, 'of', v.of, 'start', {start}, 'quota', {quota})), v -> v.quota > 0))"
    both = f"array({side('first', 'half', 'go', 'v.start', 'v.left')}, {side('first + half', 'n_shards - half', 'blocks - go', 'v.start + v.left', 'v.quota - v.left')})"
    kept = "array(named_struct('first', first, 'n_shards', n_shards, 'blocks', blocks, 'quotas', quotas))"
    return split.select(F.explode(F.expr(f"if(n_shards = 1, {kept}, {both})")).alias("node")).select("node.*")


def splitting_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, number, of, start, quota): each shard's range of every source's permuted blocks, from rows (number, quota)."""
    every = quotas.where("quota > 0").agg(F.sum("quota").alias("blocks"), F.sort_array(F.collect_list(F.struct(F.col("number").cast("long").alias("number"), F.col("quota").alias("of"), F.lit(0).cast("long").alias("start"), "quota"))).alias("quotas"))
    blocks = every.first()["blocks"] or 0
    nodes = every.where("blocks > 0").select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("n_shards"), "blocks", "quotas")
    for depth in range((shards - 1).bit_length()):
        nodes = stored(_halved(nodes, blocks, shards, seed), "mix-tree") if depth % 4 == 3 else _halved(nodes, blocks, shards, seed)
        if depth % 4 == 3:
            nodes = nodes.repartition(min(2 ** (depth + 1), 4 * quotas.sparkSession.sparkContext.defaultParallelism), "first")
    return nodes.select(F.col("first").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.*")


def permuted(at: str, n: str, key: str) -> str:
    """SQL: the place of ``at`` in a permutation of 0 to n - 1 that ``key`` decides.

    A Feistel network over a grid of a rows and b columns, the smallest near-square one of n cells and more; cells beyond n are
    walked over. There are fewer than a of them, so 64 steps are enough: for fewer than 4,096 cells by their count, and
    beyond, as a step meets one with a chance under 1/64.
    """
    step = f"""aggregate(sequence(0, 5), named_struct('l', x div g.b, 'r', x % g.b), (s, i) -> if(i % 2 = 0,
        named_struct('l', pmod(s.l + pmod(xxhash64({key}, i, s.r), g.a), g.a), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r + pmod(xxhash64({key}, i, s.l), g.b), g.b))), s -> s.l * g.b + s.r)"""
    walk = f"aggregate(sequence(0, 63), {_let('x', at, step)}, (x, j) -> if(x < {n}, x, {step}))"
    a = f"cast(ceil(sqrt({n})) as long)"
    return _let("g", f"named_struct('a', {a}, 'b', ({n} + {a} - 1) div {a})", walk)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, line, goals), stored. pieces is the mix: number, part, place (which name a row of line), doc_id, pass,
    block, shard, word_from, word_to (within the document's words), order (within the shard, from 1 without gaps).

    A null or empty text has no words and no pieces. Null sources are a source of their own, the last one; '' is the
    first. Rows that are equal in id and text are interchangeable, and each has its own pieces. An empty table gives
    empty results. Other columns, whatever their names, are not read.
    """
    rows = stored(records(docs, id_col, text_col, source_col, seed), "mix-records")
    goals = targets(rows, weights)
    placed = line(rows, goals)
    discard(rows)
    quotas = goals.select("number", F.expr(f"(words + {block_words - 1}) div {block_words}").alias("quota"))
    shards = max(1, -(-(quotas.agg(F.sum("quota")).first()[0] or 0) // shard_blocks))
    leaves = stored(splitting_tree(quotas, shards, seed), "mix-leaves")
    drawn = leaves.select("shard", "number", "of", F.explode(F.expr("sequence(start, start + quota - 1)")).alias("at"))
    blocks = stored(drawn.select("shard", "number", F.expr(permuted("at", "of", f"{seed}L, number")).alias("block")), "mix-blocks")
    small = goals.where("words > 0").select("number", "source_size", "words")
    # pass p of the line covers p * source_size and what follows it, up to words
    passes = placed.where("size > 0").join(small, "number").where("start < words").select(
        "number", "part", "place", "doc_id", "size", "words", "start", "source_size", F.explode(F.expr("sequence(0L, (words - 1 - start) div source_size)")).alias("pass"))
    spans = passes.withColumn("begin", F.expr("pass * source_size + start")).withColumn("end", F.expr("least(begin + size, words)"))
    pieces = spans.select("number", "part", "place", "doc_id", "pass", "begin", "end", F.explode(F.expr(f"sequence(begin div {block_words}, (end - 1) div {block_words})")).alias("block")).select(
        "number", "part", "place", "doc_id", "pass", "block", F.expr(f"greatest(begin, block * {block_words}) - begin").alias("word_from"), F.expr(f"least(end, (block + 1) * {block_words}) - begin").alias("word_to"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "number", "part", "place", "pass", "block"), "number", "part", "place", "pass", "block")
    out = stored(pieces.join(blocks, ["number", "block"]).withColumn("order", F.row_number().over(order)), "mix-pieces")
    discard(leaves, blocks)
    return out, placed, goals


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_pieces, source per row; nulls, ties and empty tables as :func:`mix` says."""
    pieces, placed, goals = mix(docs, id_col, text_col, source_col, **parameters)
    key = ["number", "part", "place"]
    words = stored(pieces.groupBy(*key).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.count("*").alias("n_pieces")), "mix-taken")
    every = placed.select("doc_id", "size", *key).join(words, key, "left").na.fill(0, ["taken", "n_pieces"])
    return every.join(goals.select("number", "source", "source_size", "target"), "number").select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "source")
