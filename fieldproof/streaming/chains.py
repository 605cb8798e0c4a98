"""Hash-chained logs from a stream, with keyed state: a log's tail and the documents it has seen lately.

A micro-batch touches the state of the logs in it and no other, whatever their number. Order and state are keyed by
log; a log is a sequential fold by nature, and the rows of one log in one micro-batch stand in a task's memory, so
``files_per_batch`` bounds it. The state of a batch is Spark's own, versioned by batch, so a batch that comes again
makes the same records; the sink (:mod:`..sources.committed_log`) commits each batch once.

A log that is idle for long enough is closed: its chain gets a last record that says how many stand before it, and its
tail leaves the state. What comes for it afterwards opens another volume, named by its first record and beginning at
genesis. Each volume is a whole chain; a closed one also shows when its last lines are missing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..constants import GENESIS
from ..operators import audit
from ..operators.parse import with_parsed
from ..operators.review import with_review
from ..sources import committed_log
from . import review

DAY_MS = 86_400_000
#: State is in RocksDB, whose changes are what a batch writes; sessions of this library's streams need both settings.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Chain(StatefulProcessor):
    """Rows (log_id, seq, doc_id, at, record, arrived) to the records of :data:`..sources.committed_log.SCHEMA`.

    A doc_id that its log has seen within ``seen_ms`` is dropped, a null one never. Rows of a batch are taken in order
    of (seq, doc_id). Time is that of arrival, the batch's own, so no row is late and a batch that comes again makes the
    same records; timers fire in the first batch after they are due.
    """

    def __init__(self, idle_ms: int | None = None, seen_ms: int = DAY_MS) -> None:
        self.idle_ms, self.seen_ms = idle_ms, seen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "volume string, n long, seq long, record_hash string")
        self.seen = handle.getMapState("seen", "doc_id string", "at long")
        self.due = handle.getValueState("due", "idle long, sweep long")

    def _record(self, key: str, tail: tuple, seq: int, doc_id: str | None, record: dict) -> tuple[dict, tuple]:
        volume, n, _, before = tail
        record = record | {"prev_hash": before}
        record["record_hash"] = audit.record_hash(record)
        row = {"log_id": key, "volume": volume, "n": n + 1, "seq": seq, "doc_id": doc_id, "line": json.dumps(record, ensure_ascii=False), "prev_hash": before, "record_hash": record["record_hash"]}
        return row, (volume, n + 1, seq, record["record_hash"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (log_id,) = key
        frame = pd.concat(list(rows)).sort_values(["seq", "doc_id"], kind="stable", na_position="last")
        now = int(frame["arrived"].max())
        tail = self.tail.get() if self.tail.exists() else None
        out = []
        for seq, doc_id, at, record in zip(frame["seq"], frame["doc_id"], frame["at"], frame["record"]):
            if pd.isna(doc_id):
                doc_id = None
            elif self.seen.containsKey((doc_id,)):
                if self.seen.getValue((doc_id,))[0] > now - self.seen_ms:
                    continue
            if doc_id is not None:
                self.seen.updateValue((doc_id,), (now,))
            if tail is None:
                tail = (f"{log_id}/{at}/{seq}", 0, -1, GENESIS)
            row, tail = self._record(log_id, tail, int(seq), doc_id, json.loads(record))
            out.append(row)
        if out:
            self.tail.update(tail)
            idle, sweep = self.due.get() if self.due.exists() else (0, 0)
            if self.idle_ms is not None:
                if idle:
                    self.handle.deleteTimer(idle)
                idle = self._timer(now + self.idle_ms, sweep)
            self.due.update((idle, sweep or self._timer(now + self.seen_ms, idle)))
            yield pd.DataFrame(out)

    def _timer(self, due: int, other: int) -> int:
        """A timer at this time; a log's two timers are never at the same one."""
        due += due == other
        self.handle.registerTimer(due)
        return due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        idle, sweep = self.due.get()
        now = timerValues.getCurrentWatermarkInMs()
        if expiredTimerInfo.getExpiryTimeInMs() == sweep:
            old = [doc for doc, (at,) in self.seen.iterator() if at <= now - self.seen_ms]
            for doc in old:
                self.seen.removeKey(doc)
            more = any(True for _ in self.seen.keys())
            self.due.update((idle, self._timer(now + self.seen_ms, idle) if more else 0))
        else:
            tail = self.tail.get()
            row, _ = self._record(key[0], tail, tail[2], None, {"closed": True, "records": tail[1]})
            self.tail.clear()
            self.due.update((0, sweep))
            yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def payload(outputs: DataFrame) -> DataFrame:
    """(log_id, seq, doc_id, at, record) of raw outputs, parsed and flagged."""
    flagged = with_review(with_parsed(outputs))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    record = F.to_json(F.struct("doc_id", "raw_output", "latency_ms", "needs_review", "review_reasons", at.alias("timestamp_utc")))
    return flagged.select("log_id", "seq", "doc_id", F.coalesce(at, F.lit("")).alias("at"), record.alias("record"))


def chained(rows: DataFrame, idle_ms: int | None = None, seen_ms: int = DAY_MS) -> DataFrame:
    """The stream of chained records from a stream of :func:`payload`. Rows without a log_id or seq belong nowhere and go."""
    some = rows.where("log_id is not null and seq is not null").withColumn("clock", F.current_timestamp()).withWatermark("clock", "1 second")
    keyed = some.withColumn("arrived", F.unix_millis("clock")).groupBy("log_id")
    return keyed.transformWithStateInPandas(Chain(idle_ms, seen_ms), committed_log.SCHEMA, "Append", "EventTime")


def start(spark: SparkSession, folder: str, log: str, checkpoint: str, *, idle_ms: int | None = None, seen_ms: int = DAY_MS, files_per_batch: int = 1000, source: type = committed_log.CommittedLog) -> StreamingQuery:
    """Process what has landed and stop; a restart goes on where the checkpoint ends."""
    for key, value in STATE.items():
        spark.conf.set(key, value)
    spark.dataSource.register(source)
    rows = spark.readStream.schema(review.INCOMING).option("maxFilesPerTrigger", files_per_batch).json(folder)
    out = chained(payload(rows), idle_ms, seen_ms)
    return out.writeStream.format(source.name()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(log)


def log_rows(spark: SparkSession, log: str) -> DataFrame:
    """Committed records with their batch."""
    spark.dataSource.register(committed_log.CommittedLog)
    return spark.read.format("committed_log").load(log)


def receipts(spark: SparkSession, log: str) -> DataFrame:
    """(log_id, volume, n, doc_id, record_hash, prev_hash): what a sender is told of each record."""
    return log_rows(spark, log).select("log_id", "volume", "n", "doc_id", "record_hash", "prev_hash")


def verify(spark: SparkSession, log: str) -> DataFrame:
    """(log_id, volume, ok, records, closed) per volume: links and contents hold, and a closing record counts right."""
    rows = log_rows(spark, log)
    made = audit.links(audit.opened(rows.select("volume", "n", "line")), "volume", "n", F.floor(F.col("n") / audit.BLOCK_LINES))
    last = rows.groupBy("volume").agg(F.max_by("line", "n").alias("line"), F.first("log_id").alias("log_id"), F.max("n").alias("n"), F.countDistinct("n").alias("places"), F.count("*").alias("rows"))
    closed = F.coalesce(F.get_json_object("line", "$.closed") == "true", F.lit(False))
    whole = ~closed | (F.get_json_object("line", "$.records").cast("long") == F.col("n") - 1)
    even = (F.col("places") == F.col("rows")) & (F.col("n") == F.col("rows"))
    return made.join(last, "volume").select("log_id", "volume", (F.col("bad").isNull() & whole & even).alias("ok"), "records", closed.alias("closed"))
