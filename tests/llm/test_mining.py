"""Phrases, mixing and source divergence against plain versions: nulls, empty and very long texts, ties, repeated rows,
empty tables, clashing names, one hot key."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldproof.llm import divergence, mixing, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, phrase string, h string, term string, number string, size string, part string, f string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "a", "b", "c", "d", "e", "f", "g") for r in rows], SCHEMA).repartition(3)


def corpus(n=150, seed=4):
    r = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉPSILON", "zeta", "x1", "it's", "a-b", " ", "word"]
    out = []
    for i in range(n):
        hot = r.random() < 0.4
        text = "".join(r.choice(words[:3] if hot else words) + r.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "!?", "\x0b"]) for _ in range(r.randint(0, 60)))
        out.append((i, text, "en" if hot else r.choice(["fr", "", None, "und"]), r.choice(["s0", "s0", "s1", "", None, "é"])))
    out += [(900, None, "fr", "alone"), (901, "", "xx", "only"), (None, "alpha beta alpha beta", "en", "s1"), (902, "Alpha beta " * 20_000, "en", "long"), (903, " \t\n", None, None)]
    return out + out[:9]


# -- phrases ---------------------------------------------------------------------------------------------------------
def phrases_plain(rows, least, reported):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    frequent = {key: a for key, a in f.items() if a >= least}
    for (lang, words), a in frequent.items():
        if len(words) > 1:
            cuts = [(2_000_000 * a // (f[lang, words[:j]] + f[lang, words[j:]]), j) for j in range(1, len(words))]
            score, j = min(cuts)
            inside = any(of == lang and len(longer) > len(words) and 100 * b >= 80 * a and any(longer[i : i + len(words)] == words for i in range(len(longer))) for (of, longer), b in frequent.items())
            if not inside:
                found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:j]], f[lang, words[j:]]))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, each in found.items() for rank, (score, a, p, l, r) in enumerate(sorted(each)[:reported], 1)}


@pytest.mark.parametrize("parameters", [{"least": 3}, {"least": 3, "exact": 2}, {"least": 2, "reported": 5}])
def test_phrases_against_a_plain_count(spark, parameters):
    rows = corpus()
    got = phrases.mine(frame(spark, rows), **parameters).collect()
    expected = phrases_plain(rows, parameters["least"], parameters.get("reported", 2000))
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 10


def test_phrases_of_small_chunks_and_of_no_rows(spark, monkeypatch):
    rows = corpus(60, 5)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 50)
    assert {tuple(r) for r in phrases.mine(frame(spark, rows), least=2).collect()} == phrases_plain(rows, 2, 2000)
    assert phrases.mine(frame(spark, [])).collect() == []
    assert phrases.mine(frame(spark, [(1, None, None, None)])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_a_bitmap_never_misses(spark):
    level = spark.range(5000).select(F.xxhash64("id").alias("h"))
    h = level.toArrow().column("h").to_numpy().view("uint64")
    for exact, bits in ((1 << 13, False), (1 << 10, True)):
        known = phrases._set_of(level, exact)
        assert known.bits is bits and known.has(h).all()
    other = spark.range(5000, 9000).select(F.xxhash64("id").alias("h")).toArrow().column("h").to_numpy().view("uint64")
    assert not phrases._set_of(level, 1 << 13).has(other).any() and phrases._set_of(level, 1 << 10).has(other).mean() < 0.2


# -- mixing ----------------------------------------------------------------------------------------------------------
def targets_plain(sizes):
    """The contract's own steps, in fractions: share by weight, stop at twice the size, share the rest anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, out = set(names), {}
    while True:
        left = Fraction(3, 2) * sum(sizes.values()) - sum(out.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        open_ -= over


def test_mixing(spark):
    rows = corpus()
    docs = frame(spark, rows)
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    goals = targets_plain(sizes)
    got = mixing.taken(docs, block_words=64, shard_blocks=8).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"]) for r in got) == sorted((d if d is not None else -1, size(t)) for d, t, *_ in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goals[r.source], rel_tol=1e-12, abs_tol=1e-9) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goals[s]) <= Fraction(1, 2) for s in sizes)
    again = mixing.taken(docs.repartition(7), block_words=64, shard_blocks=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_blocks_are_drawn_once_and_shards_are_even(spark):
    pieces, line, goals = mixing.mix(frame(spark, corpus()), block_words=64, shard_blocks=8)
    rows = pieces.collect()
    quota = {r.number: -(-r.words // 64) for r in goals.collect()}
    held = {(r.number, r.block): r.shard for r in rows}
    assert Counter(n for n, _ in held) == Counter({n: q for n, q in quota.items() if q})
    assert all((r.number, r.block, r.shard) in {(*k, v) for k, v in held.items()} for r in rows)
    loads = Counter(held.values())
    assert len(loads) == -(-sum(quota.values()) // 8) > 20 and max(loads.values()) - min(loads.values()) <= 1
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.order)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    # the words of a row are covered from its first one, as often as it is taken
    size = {(r.number, r.part, r.place): r["size"] for r in line.collect()}
    spans = {}
    for r in rows:
        spans.setdefault((r.number, r.part, r.place, r["pass"]), []).append((r.word_from, r.word_to))
    for (*row, _), each in spans.items():
        each.sort()
        assert each[0][0] == 0 and all(a[1] == b[0] for a, b in zip(each, each[1:])) and each[-1][1] <= size[tuple(row)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", "en", "a"), (1, "", "en", "a")]])
def test_mixing_without_words(spark, rows):
    assert [(r["size"], r.target, r.taken) for r in mixing.taken(frame(spark, rows)).collect()] == [(0, 0.0, 0)] * len(rows)


def test_mixing_one_source_only(spark):
    (got,) = mixing.taken(frame(spark, [(1, "a b c", "en", "a")])).collect()
    assert (got.target, got.taken) == (4.5, 5)


@pytest.mark.parametrize("t,m,n", [(10, 4, 5), (40, 39, 20), (7, 0, 3), (7, 7, 3), (200, 50, 100), (5, 2, 0), (5, 2, 5)])
def test_hypergeometric_draws(spark, t, m, n):
    steps = 4000
    draw = mixing.hypergeometric(f"{t}L", f"{m}L", f"{n}L", "u")
    got = dict(spark.range(steps).select(((F.col("id") + 0.5) / steps).alias("u")).select(F.expr(draw).alias("x")).groupBy("x").count().collect())
    exact = {x: math.comb(m, x) * math.comb(t - m, n - x) / math.comb(t, n) for x in range(max(0, n - t + m), min(m, n) + 1)}
    assert set(got) <= set(exact) and all(abs(got.get(x, 0) / steps - p) <= 1.01 / steps for x, p in exact.items())


def test_a_leafs_quotas_are_those_of_a_shuffle(spark):
    """Over 12 seeds, shards of 8 blocks get a source's blocks about as often as a dealt deck would."""
    quotas = spark.createDataFrame([(0, 20), (1, 15), (2, 5)], "number int, quota long")
    seen = Counter()
    for seed in range(12):
        leaves = {(x.shard, x.number): x.quota for x in mixing.splitting_tree(quotas, 5, seed).collect()}
        assert all(sum(q for (s, _), q in leaves.items() if s == shard) == 8 for shard in range(5))
        assert [sum(q for (_, i), q in leaves.items() if i == number) for number in range(3)] == [20, 15, 5]
        seen.update(leaves.get((s, 0), 0) for s in range(5))
    exact = {x: math.comb(20, x) * math.comb(20, 8 - x) / math.comb(40, 8) for x in range(9)}
    assert all(abs(seen[x] / 60 - p) < 0.2 for x, p in exact.items())


def test_permutations(spark):
    every = spark.range(1, 130).withColumnRenamed("id", "n").selectExpr("n", "explode(sequence(0L, n - 1)) as at").select("n", "at", F.expr(mixing.permuted("at", "n", "7L, n")).alias("to"))
    for r in every.groupBy("n").agg(F.collect_set("to").alias("to"), F.sum(F.expr("int(at = to)")).alias("fixed")).collect():
        assert sorted(r.to) == list(range(r.n)) and (r.n < 20 or r.fixed < r.n / 3)
    large = spark.range(50_000).select(F.expr(mixing.permuted("id", "50000L", "1L, 2")).alias("to")).agg(F.countDistinct("to"), F.min("to"), F.max("to")).first()
    assert tuple(large) == (50_000, 0, 49_999)


# -- divergence ------------------------------------------------------------------------------------------------------
def audit_plain(rows, least, ranked):
    count, docs, groups = Counter(), Counter(), {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.setdefault(lang, set()).add(source)
        count.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (of, t), n in docs.items() if of == lang and n >= least)
        share = lambda each: [1 + 1_000_000_000 * (c + 2) // (sum(each) + 2 * len(kept)) for c in each]
        held = {s: [count[lang, s, t] for t in kept] for s in sources}
        p = {s: share(held[s]) for s in sources}
        q = share([sum(held[s][i] for s in sources) for i in range(len(kept))])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(map(f, p[s], p[o])), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][i], q[i]), t.encode()) for i, t in enumerate(kept) if held[s][i] and p[s][i] > q[i]]
            for part, each in (("pair", sorted(pair)), ("term", sorted(term)[:ranked])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(each, 1)}
    return out


@pytest.mark.parametrize("least,ranked,chunk", [(10, 10, 2 << 20), (1, 2, 60), (1000, 10, 2 << 20)])
def test_divergence_against_plain_sums(spark, monkeypatch, least, ranked, chunk):
    rows = corpus()
    monkeypatch.setattr(divergence, "CHUNK_BYTES", chunk)
    got = divergence.audit(frame(spark, rows), least_docs=least, ranked=ranked).collect()
    expected = audit_plain(rows, least, ranked)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert {r.part for r in got} == ({"pair"} if least == 1000 else {"pair", "term"}) and all(r.value == 0 for r in got if least == 1000)


def test_divergence_without_rows_or_terms(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    got = divergence.audit(frame(spark, [(1, None, None, None), (2, "", None, "b"), (3, "1 2 3", "fr", "b")])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_shares_of_counts_beyond_64_bits(spark):
    """A thousand million times a count of 10**13 needs more than 64 bits."""
    (got,) = spark.sql("select 10000000000000L as n, 30000000000001L as total, 5L as terms").select(F.expr(divergence._share("n", "total")).alias("p")).collect()
    assert got.p == 1 + 10**9 * (10**13 + 2) // (30000000000001 + 10)
