"""Digests of tables, and the index of JSON Lines files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldproof.operators import digest
from fieldproof.sources import line_index
from fieldproof.streaming import gold

SCHEMA = "id long, name string, x double"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ROWS = [(1, "a", 0.5), (2, None, None), (3, "", 1.0), (3, "", 1.0), (4, "é", float("nan"))]


def test_equality_is_of_multisets(spark):
    left = _rows(spark, ROWS)
    assert digest.equal(left, _rows(spark, ROWS[::-1])) and digest.equal(left.limit(0), left.limit(0))
    for other in (ROWS[:-1], ROWS + ROWS[:1], [(1, "a", 0.5), (2, "", None), *ROWS[2:]], [(1, None, 0.5), (2, "a", None), *ROWS[2:]], []):
        assert not digest.equal(left, _rows(spark, other))
    assert digest.equal(left.select("x", "id"), _rows(spark, ROWS), ["id"])


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_difference_against_counters(spark, bits):
    from collections import Counter

    r = random.Random(bits)
    a = [(r.randint(0, 9), r.choice(["a", "b", None, ""]), r.choice([1.0, None])) for _ in range(200)]
    b = r.sample(a, 150) + [(r.randint(0, 20), r.choice(["a", "c"]), 2.0) for _ in range(20)]
    left, right = _rows(spark, a), _rows(spark, b)
    expected = Counter(a)
    expected.subtract(Counter(b))
    found = {(x.id, x.name, x.x): x.n for x in digest.difference(left, right, bits=bits).select("id", F.col("name").alias("name"), "x", "n").collect()}
    assert found == {k: n for k, n in expected.items() if n}
    assert digest.contains(left, _rows(spark, a[:50]), bits=bits) and not digest.contains(left, right, bits=bits)
    assert digest.difference(left, _rows(spark, a), bits=bits).collect() == []
    kept = digest.digests(left, bits=bits)
    parts = digest.merged(digest.digests(_rows(spark, a[:70]), bits=bits), digest.digests(_rows(spark, a[70:]), bits=bits))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, parts.select(*kept.columns).collect()))
    assert digest.difference(left, right, bits=bits, left_digests=parts).count() == len(found)


def _json(i, v):
    return json.dumps({"doc_id": f"d{i}", "v": v, "t": "ü" * (i % 50)}, ensure_ascii=False)


@pytest.mark.parametrize("range_bytes", [1 << 25, 97, 4096])
def test_index_reads_only_the_ranges_asked_for(spark, tmp_path, range_bytes):
    log, index = tmp_path / "log.jsonl", str(tmp_path / "index")
    log.write_text("".join(_json(i % 400, i) + "\n" for i in range(500)) + "\n{not json\n" + json.dumps({"v": 1}) + "\n" + '{"doc_id": "half')
    made = line_index.build(spark, str(tmp_path / "*.jsonl"), index, range_bytes=range_bytes)
    assert made.where("key is not null").count() == 500 and made.where("key is null").count() == 2
    text = log.read_bytes()
    assert all(json.loads(text[r.start : r.start + r.length])["doc_id"] == r.key for r in made.where("key is not null").collect())
    places = line_index.lookup(spark, index, ["d7", "d399", "none"])
    assert {r.key: json.loads(r.line)["v"] for r in line_index.records(places).collect()} == {"d7": 407, "d399": 399}
    # what is added is indexed, the half line when it is whole; nothing new adds no generation
    with open(log, "a") as f:
        f.write('way", "v": 5}\n' + _json(7, "new") + "\n")
    (tmp_path / "zz.jsonl").write_text(_json(399, "later file") + "\n")
    line_index.build(spark, str(tmp_path / "*.jsonl"), index, range_bytes=range_bytes)
    assert line_index.build(spark, str(tmp_path / "*.jsonl"), index).count() == 505
    assert sorted(x for x in os.listdir(index) if x.startswith("generation")) == ["generation=0", "generation=1"]
    assert line_index.records(line_index.lookup(spark, index + "-none", ["d7"])).collect() == []
    keys = spark.createDataFrame([("d7",), ("d399",), ("halfway",), ("d7",), (None,), ("none",)], "key string")
    assert {r.key: json.loads(r.line)["v"] for r in line_index.records(line_index.joined(spark, index, keys)).collect()} == {"d7": "new", "d399": "later file", "halfway": 5}
    log.write_text("")
    with pytest.raises(ValueError, match="shorter"):
        line_index.build(spark, str(tmp_path / "*.jsonl"), index)


def test_a_bundle_opens_its_ranges_and_no_more(spark, tmp_path):
    """Everything but the ten lines is overwritten with line feeds of the same length: the ten are read all the same."""
    log, index = tmp_path / "log.jsonl", str(tmp_path / "index")
    log.write_text("".join(_json(i, i) + "\n" for i in range(20_000)))
    line_index.build(spark, str(log), index)
    places = line_index.lookup(spark, index, [f"d{i * 1999}" for i in range(10)]).collect()
    text, keep = log.read_bytes(), bytearray(b"\n" * log.stat().st_size)
    for p in places:
        keep[p.start : p.start + p.length] = text[p.start : p.start + p.length]
    log.write_bytes(bytes(keep))
    got = line_index.records(spark.createDataFrame(places)).collect()
    assert sorted(json.loads(r.line)["v"] for r in got) == [i * 1999 for i in range(10)]


def test_live_samples_meet_gold_that_arrives_between_batches(spark, tmp_path):
    for name in ("in", "gold"):
        (tmp_path / name).mkdir()
    run = lambda: gold.live(spark, spark.readStream.schema("doc_id string, at int").json(str(tmp_path / "in")), str(tmp_path / "gold/*.jsonl"), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp"), "doc_id string, v string").awaitTermination()
    land = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "gold/a.jsonl").write_text(_json(1, "one") + "\n")
    land("a.json", [{"doc_id": "d1", "at": 1}, {"doc_id": "d2", "at": 1}, {"doc_id": None, "at": 1}])
    run()
    with open(tmp_path / "gold/a.jsonl", "a") as f:
        f.write(_json(2, "two") + "\n" + _json(1, "one again") + "\n")
    land("b.json", [{"doc_id": "d1", "at": 2}, {"doc_id": "d2", "at": 2}, {"doc_id": "d3", "at": 2}])
    run()
    got = {(r.doc_id, r["at"]): r.gold and r.gold.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("d1", 1): "one", ("d2", 1): None, (None, 1): None, ("d1", 2): "one again", ("d2", 2): "two", ("d3", 2): None}
