"""Claims whose numbers chance to meet, rewards by the batch, and expressions that name a value once."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldproof.constants import FIELDS, PAGE_HEIGHT, PAGE_WIDTH
from fieldproof.functions import geometry as G
from fieldproof.functions import text as T
from fieldproof.operators import generator, rewards


def test_a_total_that_ends_like_the_smaller_amount(spark, tmp_path):
    day = datetime.date(1995, 3, 4)
    tables = {
        "orders": ([(k, 1, day, "2-HIGH", Decimal(price)) for k, price in ((32, "412347.25"), (146, "99.10"), (203, "1017.25"), (260, "7217.25"))], "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_totalprice decimal(15, 2)"),
        "customer": ([(1, "Customer#000000001", 1, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(1, 1)], "n_nationkey int, n_regionkey int"), "region": ([(1, "ASIA")], "r_regionkey int, r_name string")}
    duck = duckdb.connect()
    for name, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    made = entry.queries()["scored_fields"](spark, str(tmp_path))
    amounts = made.where("field = 'total_amount' and p_norm = '7.25'").collect()
    assert amounts and not any(r.evidence_supported for r in amounts)
    found = duck.execute(entry.oracle_sql()["scored_fields"])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in made.select(*[f"`{c}`" for c in names]).collect())


def test_rewards_of_many_documents_at_once(spark):
    rows = spark.range(40).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("r"), F.col("id") % 3)).alias("run_id"), F.concat(F.lit("d"), "id").alias("doc_id"), F.posexplode(F.array(*map(F.lit, FIELDS))).alias("field_pos", "field"))
    rows = rows.withColumn("worth", F.crc32(F.concat("doc_id", "field")) % 7)
    one = {(r.run_id, r.doc_id): r.reward for r in rewards.rewarded(rows, lambda doc: float(doc["worth"].sum())).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        # documents that go on in the next batch, and batches that end with a document
        for size in (3, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            made = rewards.rewarded_at_once(rows.repartition(3), lambda many: many["worth"].to_numpy().reshape(-1, len(FIELDS)).sum(axis=1))
            assert {(r.run_id, r.doc_id): r.reward for r in made.collect()} == one and made.count() == 40
            assert made.columns == ["run_id", "doc_id", "reward"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    many = lambda rows: [1.0] * (len(rows) // len(FIELDS))
    for f, where in ((lambda rows: [1.0], "true"), (lambda rows: [float("nan")] * (len(rows) // len(FIELDS)), "true"), (many, "doc_id != 'd7' or field_pos > 0")):
        with pytest.raises(Exception, match="document"):
            rewards.rewarded_at_once(rows.where(where), f).collect()


def test_a_bound_value_is_named_once(spark):
    box, other = F.col("first_box"), F.col("other_box")
    assert str(T.rounded(F.col("the_value"), 3)).count("the_value") == 1
    # corners are named, but the overlap is not copied into the union and again into each step of rounding
    assert str(T.rounded(G.iou(box, other), 3)).count("first_box") < 30
    text = spark.createDataFrame([(0.0005, 2.5, -0.00049999, None)], "a double, b double, c double, d double")
    assert [*text.select(*[T.rounded(F.col(c), 3) for c in "abcd"]).first()] == [round(0.0005, 3), 2.5, round(-0.00049999, 3), None]


def test_documents_of_one_small_file_are_made_by_many_tasks(spark):
    base = spark.range(30).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("s"), "id").alias("set_id")).coalesce(1)
    assert generator.counterfactuals(base).select("set_id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_turned_box_is_named_by_its_corners(spark):
    assert str(G.rotated(F.col("the_box"), F.col("angle"))).count("the_box") < 12
    boxes = [(0.0, 0.0, 30.0, 20.0), (100.5, 200.25, 400.0, 260.0), (900.0, 1200.0, 980.0, 1260.0)]
    for degrees in (-3.0, 0.0, 1.7, 90.0):
        made = spark.createDataFrame([(list(b), degrees) for b in boxes], "b array<double>, d double").select(G.rotated(F.col("b"), F.col("d")).alias("r"))
        t, cx, cy = math.radians(degrees), PAGE_WIDTH / 2, PAGE_HEIGHT / 2
        for (x0, y0, x1, y1), row in zip(boxes, made.collect()):
            xs, ys = zip(*[(cx + (x - cx) * math.cos(t) + (y - cy) * math.sin(t), cy - (x - cx) * math.sin(t) + (y - cy) * math.cos(t)) for x in (x0, x1) for y in (y0, y1)])
            hull = [max(0.0, min(xs)), max(0.0, min(ys)), min(float(PAGE_WIDTH), max(xs)), min(float(PAGE_HEIGHT), max(ys))]
            assert list(row.r) == pytest.approx([x0, y0, x1, y1] if degrees == 0 else hull, abs=1e-9)
