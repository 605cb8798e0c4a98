"""Near-duplicate groups by a chosen-path set similarity join.

Documents are sets of distinct five-word shingles. Equal sets become one class first, with a number of its own, so a
group of copies costs one row. Each class has minwise values. The roots of ROOTS independent trees split all classes by one minwise value each;
deeper levels split each large node by two minwise values that the node's own hash chooses among its level's own, so
that no path meets one twice. Nodes of at most ``leaf`` classes are compared exhaustively on sketches. In a larger node
all classes are compared with a pivot; with d = 1 - likeness, a metric, what is within 0.2 of the pivot goes no deeper,
as whatever is within 0.25 of it is within 0.45 of the pivot and so linked to it. Where all but a 64th is linked to
the pivot, the rest is linked as well and the node ends there: it is one cluster. What ``depth`` levels have not split
is compared exhaustively in cells, every block with every other. The trees' candidate links, thinned to spanning
forests, give clusters that are a little too coarse; inside each cluster links are confirmed on the full sets, exactly,
and the groups come from confirmed links alone.

Recall: a pair at 0.75 has 1.5 common children per level on average, so it goes on together below a large root with
probability s = 1 - (1 - 0.75 s)**2 = 0.89 at least, however deep. It parts in all trees with probability
(1 - 0.75 * 0.89)**ROOTS = 2e-6 (0.25**ROOTS where roots are small), if values were independent; and the bound for
comparing sketches (coarse) lies over four standard deviations under the threshold. Unlinked classes share under half
of their values with the pivot, so two children hardly let a level's rows grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import components, discard, stored, text_column

SKETCH = 128  # minwise values kept at 8 bits, for estimates
ROOTS = 12  # minwise values kept at 32 bits, for the root level's branches
_BYTES = 4 * ROOTS + SKETCH
_rng = np.random.default_rng(75)
_MUL = _rng.integers(1, 2**63, SKETCH + ROOTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SKETCH + ROOTS, dtype=np.int64).astype(np.uint64)


def minwise(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, _BYTES) bytes: ROOTS minwise values of 32 bits, then SKETCH of 8 bits; no text may be empty."""
    out = np.empty((len(bounds) - 1, _BYTES), np.uint8)
    roots = out[:, : 4 * ROOTS].view(np.uint32) if len(out) else None
    if len(out):
        with np.errstate(over="ignore"):
            for j in range(SKETCH + ROOTS):
                low = np.minimum.reduceat(hashes * _MUL[j] + _ADD[j], bounds[:-1])
                if j < ROOTS:
                    roots[:, j] = low >> np.uint64(32)
                else:
                    out[:, 4 * ROOTS + j - ROOTS] = K.mix(low) >> np.uint64(56)
    return out


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles without repeats, sorted, with new bounds."""
    sets = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def set_names(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each text's set."""
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
        other = np.concatenate(([np.uint64(0)], np.cumsum(K.mix(values + np.uint64(99)), dtype=np.uint64)))
        return total[bounds[1:]] - total[bounds[:-1]], other[bounds[1:]] - other[bounds[:-1]] + np.diff(bounds).astype(np.uint64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.chunks(batch, "text"):
            values, bounds = distinct_sets(*K.text_shingles(part.column("text")))
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            k1, k2 = set_names(values, bounds)
            rows = minwise(values, bounds[np.concatenate((some, [len(size)]))]) if len(some) else np.empty((0, _BYTES), np.uint8)
            sketch: list[bytes | None] = [None] * len(size)
            for i, row in zip(some, rows):
                sketch[i] = row.tobytes()
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(size), pa.array(k1.view(np.int64), mask=none), pa.array(k2.view(np.int64), mask=none), pa.array(sketch, pa.binary())],
                names=["doc_id", "key", "n_shingles", "k1", "k2", "sketch"])


def _node(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(7)
    with np.errstate(over="ignore"):
        for p in parts:
            out = K.mix(np.asarray(out * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.uint64), dtype=np.uint64))
    return out


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = _rows(batch.column("sketch"))
            roots = np.ascontiguousarray(rows[:, : 4 * ROOTS]).view(np.uint32)
            ids = np.asarray(batch.column("rep"))
            nodes = [_node(c, roots[:, c]) for c in range(ROOTS)]
            yield pa.RecordBatch.from_arrays([K.as_i64(np.concatenate(nodes)), pa.array(np.tile(ids, len(nodes)))], names=["node", "rep"])


def _rows(column: pa.Array) -> np.ndarray:
    raw, _ = K.text_bytes(column)
    return raw.reshape(-1, _BYTES) if len(raw) else np.empty((0, _BYTES), np.uint8)


def _sketches(column: pa.Array) -> np.ndarray:
    return _rows(column)[:, 4 * ROOTS :]


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches sorted by it; only the open key's rows wait."""
    open_rows: list[pa.RecordBatch] = []
    for batch in batches:
        values = np.asarray(batch.column(key))
        if not len(values):
            continue
        edges = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
        if open_rows and open_rows[-1].column(key)[0].as_py() != values[0]:
            yield pa.Table.from_batches(open_rows)
            open_rows = []
        for a, b in zip(edges[:-1], edges[1:]):
            open_rows.append(batch.slice(a, b - a))
            if b < len(values):
                yield pa.Table.from_batches(open_rows)
                open_rows = []
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def _forest(like: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links (id, smallest id of its group) for the groups of a symmetric boolean matrix."""
    n, out, left = len(ids), [], np.ones(len(ids), bool)
    for i in np.argsort(ids, kind="stable"):
        if left[i]:
            group = np.zeros(n, bool)
            group[i] = True
            edge = group
            while edge.any():
                edge = like[edge].any(axis=0) & ~group
                group |= edge
            left &= ~group
            out += [(int(x), int(ids[i])) for x in ids[group] if x != ids[i]]
    return out


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])


def _alike(s: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of sketches agree in at least ``least`` places."""
    out = np.empty((len(s), len(s)), bool)
    step = max(1, (4 << 20) // (len(s) * SKETCH))
    for a in range(0, len(s), step):
        out[a : a + step] = np.count_nonzero(s[a : a + step, None, :] == s[None, :, :], axis=2) >= least
    return out


def _compare_small(coarse: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _by_key(batches, "node"):
            ids = np.asarray(group.column("rep"))
            s = _sketches(group.column("sketch").combine_chunks())
            if len(ids) == 2:
                if np.count_nonzero(s[0] == s[1]) >= coarse:
                    out.append((int(ids.max()), int(ids.min())))
            elif len(ids) > 2:
                out += _forest(_alike(s, coarse), ids)
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _compare_pivots(coarse: int, absorbed: int, level: int, depth: int):
    """Of (node, rep, sketch, pivot, pivot_sketch): links to the pivot (node null; far where the sketches don't bear
    them), and children of what goes on, with the node they come from."""
    own = np.arange(level % min(depth, SKETCH // 2), SKETCH, min(depth, SKETCH // 2))  # this level's values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, rep, pivot = (np.asarray(batch.column(c)) for c in ("node", "rep", "pivot"))
            s, p = _sketches(batch.column("sketch")), _sketches(batch.column("pivot_sketch"))
            same = (s == p).sum(axis=1)
            link = np.flatnonzero(rep != pivot)
            on = np.flatnonzero(same < absorbed)
            key = node.view(np.uint64)[on]
            first = _node(key, 17) % np.uint64(len(own))
            second = (first + np.uint64(1) + _node(key, 18) % np.uint64(len(own) - 1)) % np.uint64(len(own))
            kids = [_node(key, b, s[on, own[c.astype(np.int64)]]) for b, c in enumerate((first, second))]
            kids = np.concatenate(kids).view(np.int64)
            n = len(link)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((np.zeros(n, np.int64), kids)), mask=np.arange(n + len(kids)) < n), pa.array(np.concatenate((rep[link], np.tile(rep[on], 2)))),
                 pa.array(np.concatenate((pivot[link], np.tile(node[on], 2)))), pa.array(np.concatenate((node[link], np.tile(node[on], 2)))),
                 pa.array(np.concatenate((same[link] < coarse, np.zeros(len(kids), bool))))],
                names=["node", "u", "v", "parent", "far"])

    return run


def _cells(big: DataFrame, leaf: int) -> DataFrame:
    """(node, rep, sketch): blocks of half a leaf, each put together with every other of its node, so all pairs meet."""
    parts = F.expr(f"if(size <= {leaf}, 1L, ceil(size / {max(1, leaf // 2)}))")
    dealt = big.withColumn("parts", parts).withColumn("a", F.expr("pmod(xxhash64(rep, node), parts)")).withColumn("b", F.explode(F.expr("sequence(0L, parts - 1)")))
    return dealt.select(F.xxhash64("node", F.least("a", "b"), F.greatest("a", "b")).alias("node"), "rep", "sketch")


def candidate_links(reps: DataFrame, leaf: int, coarse: float, pivot_coarse: float, absorbed: float, depth: int) -> DataFrame:
    """Links (u, v) between classes that resemble each other by sketch: per node a spanning forest or a star."""
    least, star, most = int(coarse * SKETCH), int(pivot_coarse * SKETCH), int(np.ceil(absorbed * SKETCH))
    rows = reps.mapInArrow(_roots, "node long, rep long")
    stars, leaves, kept = [], [], []
    for level in range(depth):
        rows = stored(rows, "nodes")
        # a very common value's node is joined to its stored size, so that it can be split
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("size"), F.expr("min_by(rep, xxhash64(rep, node))").alias("pivot")).where("size > 1"), "sizes")
        members = stored(rows.join(sizes, "node").join(reps, "rep"), "members")
        discard(rows, sizes)
        kept.append(members)
        leaves.append(members.where(F.col("size") <= leaf).select("node", "rep", "sketch"))
        big = members.where(F.col("size") > leaf)
        if big.isEmpty():
            break
        pivots = big.where("rep = pivot").select("node", F.col("sketch").alias("pivot_sketch"))
        step = stored(big.join(pivots, "node").select("node", "rep", "sketch", "pivot", "pivot_sketch")
                      .mapInArrow(_compare_pivots(star, most, level, depth), "node long, u long, v long, parent long, far boolean"), "step")
        # a node that is nearly all one star becomes one cluster; the others, a row per large node, go on
        ended = stored(step.where("node is null").groupBy("parent").agg(F.expr("64 * count_if(far) <= count(*)").alias("ended")), "ended")
        kept += [step, ended]
        stars.append(step.where("node is null").join(ended, "parent").where("ended or not far").select("u", "v"))
        rows = step.where("node is not null").join(ended, "parent").where("not ended").select("node", F.col("u").alias("rep"))
    else:
        # what no level has split
        rows = stored(rows, "nodes")
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        kept += [rows, sizes]
        members = rows.join(sizes, "node").join(reps, "rep")
        leaves.append(_cells(members, leaf).select("node", "rep", "sketch"))
    small = reduce(DataFrame.union, leaves)
    links = reduce(DataFrame.union, stars, small.repartition("node").sortWithinPartitions("node").mapInArrow(_compare_small(least), "u long, v long"))
    out = stored(links.distinct(), "candidates")
    discard(*kept)
    return out


def _bitmap(ids: DataFrame, most_bits: int = 1 << 27) -> np.ndarray:
    """Bits at hashed ids, in at most ``most_bits`` whatever the input: a filter that may let others through."""
    n = ids.count()
    bits = min(most_bits, max(1 << 16, 1 << (16 * n).bit_length()))
    at = F.expr(f"pmod(xxhash64(rep), {bits})")
    words = ids.select(at.alias("b")).groupBy(F.expr("b div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).astype(np.uint32)
    return out


def _sets(filtered):
    """(k1, k2, shingles) of the documents whose place in the bitmap is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filtered.value
        for batch in batches:
            at = np.asarray(batch.column("place").fill_null(0))
            batch = batch.filter(pa.array((words[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)))
            for part in K.chunks(batch, "text"):
                values, bounds = distinct_sets(*K.text_shingles(part.column("text")))
                k1, k2 = set_names(values, bounds)
                sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([K.as_i64(k1), K.as_i64(k2), pa.array(sets, pa.binary())], names=["k1", "k2", "shingles"])

    return run


def confirmed_links(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links (id, smallest id of its group) over all pairs with den * |A & B| >= num * |A | B|.

    Breadth first: each member is compared with those that no group has reached yet, so a group of very similar
    documents costs few passes; the set of one member is marked in a table of all values, and one pass counts the
    marks of all others.
    """
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(column, np.cumsum(size)[:-1])
    mark = np.zeros(len(values), bool)
    rows = np.arange(len(sets))  # not reached yet
    flat, bounds = column, np.concatenate(([0], np.cumsum(size)))
    out: list[tuple[int, int]] = []
    while len(rows) > 1:
        root, queue = rows[0], [rows[0]]
        gone = np.zeros(len(rows), bool)
        gone[0] = True
        while queue and not gone.all():
            p = queue.pop()
            mark[own[p]] = True
            both = np.add.reduceat(mark[flat], bounds[:-1], dtype=np.int64)
            mark[own[p]] = False
            hit = ~gone & (den * both >= num * (size[p] + size[rows] - both))
            gone |= hit
            queue += rows[hit].tolist()
            out += [(int(ids[x]), int(ids[root])) for x in rows[hit]]
        keep = np.flatnonzero(~gone)
        flat = np.concatenate([own[r] for r in rows[keep]]) if len(keep) else flat[:0]
        rows = rows[keep]
        bounds = np.concatenate(([0], np.cumsum(size[rows])))
    return out


def _exact(num: int, den: int):
    """Confirmed links of whole clusters, thinned to one per document and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _by_key(batches, "cluster"):
            ids = np.asarray(group.column("rep"))
            raw, off = K.text_bytes(group.column("shingles").combine_chunks())
            flat = raw.view(np.uint64) if len(raw) else np.empty(0, np.uint64)
            out += confirmed_links(ids, [flat[a // 8 : b // 8] for a, b in zip(off[:-1], off[1:])], num, den)
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _grid(num: int, den: int):
    """Of rows sorted by (cell, member): the cell's first rows (member false) are compared with all its others.

    Emits (u, v): u of the first rows, v the known group of the other; each once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, heads = None, []
        for batch in batches:
            found = set()
            for c, member, rep, known, raw in zip(*(batch.column(x).to_pylist() for x in ("cell", "member", "rep", "known", "shingles"))):
                a = np.frombuffer(raw, np.uint64)
                if c != cell:
                    cell, heads = c, []
                if not member:
                    heads.append((rep, a))
                    continue
                for head, b in heads:
                    if (head, known) not in found and den * min(len(a), len(b)) >= num * max(len(a), len(b)):
                        both = np.concatenate((a, b))
                        both.sort(kind="stable")
                        n = int(np.count_nonzero(both[1:] == both[:-1]))
                        if den * n >= num * (len(a) + len(b) - n):
                            found.add((head, known))
            yield _pairs([x for x in found if x[0] != x[1]])

    return run


def _compared(heads: DataFrame, members: DataFrame, num: int, den: int, rows: int = 256) -> DataFrame:
    """Links of heads (cluster, block, rep, shingles) with members (cluster, parts, rep, known, shingles).

    Members are dealt to cells of about ``rows``; a block of heads goes to each cell of its cluster.
    """
    parts = members.groupBy("cluster").agg(F.ceil(F.count("*") / rows).alias("parts"))
    blocks = heads.select("cluster", "block").distinct()
    first = heads.join(parts, "cluster").select("cluster", "block", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(False).alias("member"), "rep", F.lit(None).cast("long").alias("known"), "shingles")
    other = members.join(parts, "cluster").join(blocks, "cluster").select("cluster", "block", F.expr("pmod(xxhash64(rep, 3L), parts)").alias("part"), F.lit(True).alias("member"), "rep", "known", "shingles")
    cells = first.union(other).select(F.xxhash64("cluster", "block", "part").alias("cell"), "member", "rep", "known", "shingles")
    return cells.repartition("cell").sortWithinPartitions("cell", "member").mapInArrow(_grid(num, den), "u long, v long")


def _large_clusters(sets: DataFrame, num: int, den: int, pivots: int = 32, block: int = 64) -> DataFrame:
    """Confirmed links (u, v) of clusters too large for one task, exact as to groups.

    All members are compared with some pivots. What those links don't join to its cluster's largest group is then
    compared with all members in cells of bounded size: any further link has an end outside the largest group.
    """
    sets = stored(sets.withColumn("known", F.col("rep")), "large")
    heads = sets.groupBy("cluster", F.expr(f"pmod(xxhash64(rep), {pivots})").alias("g")).agg(F.expr("min_by(rep, xxhash64(rep, 5L))").alias("rep")).select("rep")
    heads = sets.join(heads, "rep", "left_semi").withColumn("block", F.lit(0))
    first = stored(_compared(heads, sets, num, den), "links")
    groups = components(first)
    known = sets.select("cluster", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("cluster", "rep", F.coalesce("root", "rep").alias("known"))
    known = stored(known, "known")
    main = known.groupBy("cluster", "known").count().groupBy("cluster").agg(F.expr("max_by(known, struct(count, known))").alias("main"))
    rest = known.join(main, "cluster").where("known != main").select("cluster", "rep")
    rest = rest.join(rest.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("n")), "cluster").select("rep", F.expr("pmod(xxhash64(rep, 7L), n)").alias("block"))
    members = sets.drop("known").join(known.select("rep", "known"), "rep")
    return first.union(_compared(sets.join(rest, "rep"), members, num, den))


def _classes(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, leaf: int, coarse: float, pivot_coarse: float, absorbed: float, depth: int, most_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(features, classes): the rows' set names, and per set its group's smallest doc_id and its first row.

    features: doc_id, key (the text's hash), n_shingles, k1, k2. classes: k1, k2, component_id, first (doc_id, key).
    """
    base = text_column(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    features = stored(base.mapInArrow(_features, "doc_id long, key long, n_shingles long, k1 long, k2 long, sketch binary"), "features")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    grouped = features.where("k1 is not null").groupBy("k1", "k2").agg(F.min(place).alias("first"), F.first("sketch").alias("sketch"))
    # once written, the numbers stay what they are
    classes = stored(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    links = candidate_links(classes.select("rep", "sketch"), leaf, coarse, pivot_coarse, absorbed, depth)
    clusters = stored(components(links).select(F.col("node").alias("rep"), F.col("root").alias("cluster")), "clusters")
    discard(links)
    named = stored(clusters.join(classes.select("rep", "k1", "k2", "first"), "rep"), "clustered")
    some = docs.sparkSession.sparkContext.broadcast(_bitmap(named.select(F.xxhash64("first.doc_id", "first.key").alias("rep"))))
    at = F.expr(f"pmod(xxhash64(xxhash64(doc_id, key)), {len(some.value) * 32})").alias("place")
    sets = base.select("text", at).mapInArrow(_sets(some), "k1 long, k2 long, shingles binary").dropDuplicates(["k1", "k2"])
    sets = stored(sets.join(named.select("k1", "k2", "rep", "cluster"), ["k1", "k2"]).select("rep", "cluster", "shingles"), "sets")
    weight = sets.groupBy("cluster").agg(F.sum(F.length("shingles") / 8).alias("weight"))
    heavy = stored(weight.where(F.col("weight") > most_shingles).select("cluster"), "heavy")
    confirmed = sets.join(heavy, "cluster", "left_anti").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_exact(num, den), "u long, v long")
    # a cluster's links all come from its one task, each to the smallest number of its group
    groups = confirmed.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if not heavy.isEmpty():
        groups = groups.union(components(_large_clusters(sets.join(heavy, "cluster", "left_semi"), num, den)))
    groups = stored(groups, "groups")
    discard(clusters, named, sets, heavy)
    own = classes.select("rep", "k1", "k2", "first")
    rooted = stored(own.join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left").select("k1", "k2", "first", F.coalesce("root", "rep").alias("root")), "rooted")
    first = stored(rooted.groupBy("root").agg(F.min("first").alias("first")), "firsts")
    return features.drop("sketch"), rooted.select("k1", "k2", "root").join(first, "root").select("k1", "k2", F.col("first.doc_id").alias("component_id"), F.struct("first.doc_id", "first.key").alias("first"))


_DEFAULTS = {"num": 75, "den": 100, "leaf": 2048, "coarse": 0.58, "pivot_coarse": 0.48, "absorbed": 0.8, "depth": 12, "most_shingles": 1_500_000}


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Parameters and their defaults: num 75 and den 100 (links join documents with den * |A & B| >= num * |A | B|, where A
    and B are sets of five-word shingles), leaf, coarse, pivot_coarse, absorbed, depth (of the search) and most_shingles
    (of a cluster that one task confirms). A text of one to four words is one shingle; an empty, blank or null text has
    none and stays alone, linked with nothing. Each row's own text decides, also where a doc_id stands on several.
    Repeated rows keep their rows and share a group. Rows with a null doc_id take part in links but never name a group;
    their component and kept are null where no row of their group has a doc_id, and kept is null always. An empty table
    gives an empty result. Further columns are ignored.
    """
    features, classes = _classes(docs, id_col, text_col, **_DEFAULTS | parameters)
    out = features.join(classes.drop("first"), ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id = component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id, or of the smallest text hash.

    Documents without words stay, all of them but rows equal in id and text to another. A group without any doc_id
    keeps a row too. Of rows equal in id and text one stays, whatever their other columns are.
    """
    features, classes = _classes(docs, id_col, text_col, **_DEFAULTS | parameters)
    own = F.struct("doc_id", "key")
    away = features.join(classes, ["k1", "k2"]).where(~own.eqNullSafe(F.col("first"))).select("doc_id", "key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row").getField(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col("row").getField(text_col).cast("string")).alias("key"))
    a, b = rows.alias("a"), away.alias("b")
    rest = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left_anti")
    if not features.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        rest = rest.dropDuplicates(["doc_id", "key"])
    return rest.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
