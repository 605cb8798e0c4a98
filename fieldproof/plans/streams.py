"""Queries that run a stream over files made from the tables, to its end, and give what it left behind."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import written
from ..sources.working import once_folder
from ..streaming import chains, gold, review
from .catalogue import query
from .claims import table

PARTITIONS = "8"


@contextmanager
def _few_partitions(spark: SparkSession) -> Iterator[None]:
    """Each partition of a stream's state is a store of its own, so these tables want few. A stream keeps the settings that
    it starts with."""
    settings = {"spark.sql.shuffle.partitions": PARTITIONS, **chains.STATE}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@query("""select conv_id::varchar as log_id, true as ok, count(distinct turn)::bigint as records, false as closed, min(turn)::bigint as first_seq, max(turn)::bigint as last_seq from conversations where conv_id is not null and turn is not null group by conv_id""")
def streamed_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as raw outputs that land in files, each of them twice: a chained log per conversation, each turn
    once, from keyed state to a log with commits of its own; verified as a whole."""

    def write(folder: str) -> None:
        turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("log_id"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.lit("{}").alias("raw_output"), F.lit(1.0).alias("latency_ms"), F.timestamp_seconds(F.lit(0)).alias("ts"))
        turns.union(turns).repartition(4).write.json(f"{folder}/landed")
        # two batches
        with _few_partitions(spark):
            chains.start(spark, f"{folder}/landed", f"{folder}/log", f"{folder}/checkpoint", files_per_batch=2).awaitTermination()

    log = once_folder(spark, f"streamed logs {sf}", write) + "/log"
    ends = chains.log_rows(spark, log).groupBy("log_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return chains.verify(spark, log).join(ends, "log_id").select("log_id", "ok", "records", "closed", "first_seq", "last_seq")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def streamed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums by the hour from a stream of the events; one event far ahead closes all windows before it."""

    def write(folder: str) -> None:
        events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
        end = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 9 days")).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(0.0).alias("value"))
        events.union(end).repartition(4).write.parquet(f"{folder}/landed")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/landed")
        with _few_partitions(spark):
            review.windowed(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    rows = spark.read.parquet(once_folder(spark, f"streamed windows {sf}", write) + "/out").where("event_type is not null")
    # sums of a stream come in another order, so their last digits may be others
    return rows.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 6)})


@query("""select c_custkey, 1 as round, null::varchar as gold from customer union all select c_custkey, 2, case when c_custkey % 3 != 0 then c_name end from customer""")
def live_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Samples beside their gold: all customers before any gold is there, and again when two thirds of it have arrived."""

    def write(folder: str) -> None:
        customer = table(spark, sf, "customer")
        key = F.col("c_custkey").cast("string")
        lines = customer.where("c_custkey % 3 != 0").select("c_custkey", F.to_json(F.struct(key.alias("doc_id"), F.col("c_name").alias("name"))).alias("line"))
        for turn in (1, 2):
            customer.select(key.alias("doc_id"), F.lit(turn).alias("round")).coalesce(2).write.mode("append").json(f"{folder}/landed")
            if turn == 2:
                written.one_file(lines, "line", f"{folder}/gold/labels.jsonl", ["c_custkey"])
            samples = spark.readStream.schema("doc_id string, round int").json(f"{folder}/landed")
            gold.live(spark, samples, f"{folder}/gold/*.jsonl", f"{folder}/index", f"{folder}/out", f"{folder}/checkpoint", "doc_id string, name string").awaitTermination()

    rows = spark.read.parquet(once_folder(spark, f"live gold {sf}", write) + "/out")
    return rows.select(F.col("doc_id").cast("long").alias("c_custkey"), "round", F.col("gold.name").alias("gold"))
