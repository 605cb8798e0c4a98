"""Raw outputs as a stream: parse, flag, and append each micro-batch to hash-chained logs; windowed monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit
from ..operators.parse import with_parsed
from ..operators.review import with_review

INCOMING = "log_id string, seq bigint, doc_id string, raw_output string, latency_ms double, ts timestamp"


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of a landing folder of JSON lines; each file is read once."""
    return spark.readStream.schema(INCOMING).json(folder)


def reviewed(outputs: DataFrame) -> DataFrame:
    """outputs with review_reasons; a document seen again within a day of event time is dropped."""
    once = outputs.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["log_id", "doc_id"]) if outputs.isStreaming else outputs.dropDuplicates(["log_id", "doc_id"])
    return with_review(with_parsed(once))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _tails(spark: SparkSession, log_path: str, batch_id: int) -> tuple[DataFrame | None, int | None]:
    """(log_id, record_hash) of each log's last record before this batch, and the batch that wrote it down.

    A log without such a table (its batch is then null) is read as a whole, once.
    """
    if _exists(spark, f"{log_path}_tails"):
        known = spark.read.schema("log_id string, record_hash string, batch_id long").parquet(f"{log_path}_tails").where(F.col("batch_id") < batch_id)
        last = known.agg(F.max("batch_id")).first()[0]
        if last is not None:
            return known.where(F.col("batch_id") == last).drop("batch_id"), last
    if not _exists(spark, log_path):
        return None, None
    before = spark.read.parquet(log_path).where(F.col("batch_id") < batch_id)
    return audit.last_hash(before.select("log_id", "record_hash", F.struct("batch_id", "seq").alias("line_no"))), None


def append_batch(log_path: str):
    """A foreachBatch sink: chains the batch after each log's tail. A batch that comes again writes its files again.

    Tails stand in a table of their own beside the log, a row per log, written anew by each batch after its records. The
    one before is kept, as a batch that comes again goes on from there; older ones are deleted.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tails, at = _tails(spark, log_path, batch_id)
        record = F.to_json(F.struct("doc_id", "raw_output", "latency_ms", "needs_review", "review_reasons", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp_utc")))
        lines = audit.appended(batch.select("log_id", "seq", record.alias("record")), tails)
        rows = audit.opened(lines).select("log_id", "seq", "doc_id", "line", "prev_hash", "record_hash", F.lit(batch_id).cast("long").alias("batch_id"))
        _put(rows, log_path)
        written = spark.read.schema(rows.schema).parquet(log_path).where((F.col("batch_id") == batch_id) & F.col("log_id").isNotNull())
        now = audit.last_hash(written, order_col="seq")
        if tails is not None:
            now = now.union(tails.join(now, "log_id", "left_anti"))
        _put(now.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{log_path}_tails")
        if at is not None:
            _forget(spark, f"{log_path}_tails", at)

    return sink


def _put(rows: DataFrame, path: str) -> None:
    """Write a batch's partition, in place of what an earlier try wrote."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete the partitions of batches before this one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        key, _, value = status.getPath().getName().partition("=")
        if key == "batch_id" and int(value) < batch_id:
            fs.delete(status.getPath(), True)


def start(spark: SparkSession, folder: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed and stop; a restart goes on where the checkpoint ends."""
    return (
        reviewed(incoming(spark, folder)).writeStream.foreachBatch(append_batch(log_path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def verify_log(spark: SparkSession, log_path: str) -> DataFrame:
    rows = spark.read.parquet(log_path).select("log_id", F.struct("batch_id", "seq").alias("at"), "line")
    block = F.struct("at.batch_id", F.floor(F.col("at.seq") / audit.BLOCK_LINES).alias("part"))
    return audit.links(audit.opened(rows), "log_id", "at", block).select("log_id", F.col("bad").isNull().alias("ok"), "records")


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, sums and review shares by event-time window, for batch and stream alike."""
    # a watermark is a point in time, so times without a zone are read in the session's
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
