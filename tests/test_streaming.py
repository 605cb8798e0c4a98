import json
import time

import pytest
from pyspark.sql import functions as F

from fieldproof.sources import committed_log
from fieldproof.streaming import chains, review


def _land(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_restart_does_not_repeat_and_chain_holds(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda i: {"log_id": f"l{i % 2}", "seq": i, "doc_id": f"d{i}", "raw_output": "{}", "latency_ms": 1.0, "ts": "2025-01-01T00:00:00"}
    _land(folder, "a.json", [row(i) for i in range(4)])
    for extra in (None, [row(4), row(5), row(0)]):
        if extra:
            _land(folder, "b.json", extra)
        review.start(spark, str(folder), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    review.start(spark, str(folder), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r.doc_id for r in rows.collect()) == [f"d{i}" for i in range(6)]
    got = {r.log_id: (r.ok, r.records) for r in review.verify_log(spark, str(tmp_path / "log")).collect()}
    assert got == {"l0": (True, 3), "l1": (True, 3)}
    # a batch that comes again goes on from the tails before it, and leaves the same records
    last = rows.agg(F.max("batch_id")).first()[0]
    batch = rows.where(F.col("batch_id") == last).select("log_id", "seq", "doc_id", F.lit("{}").alias("raw_output"), F.lit(1.0).alias("latency_ms"), F.timestamp_seconds(F.lit(0)).alias("ts"))
    again = spark.createDataFrame(batch.collect(), batch.schema)
    assert again.count() == 2
    sink = review.append_batch(str(tmp_path / "log"))
    sink(review.reviewed(again), last)
    # then one log only: of tails the last and those before them stand there, and hold all logs
    sink(review.reviewed(spark.createDataFrame([("l0", 7, "d7", "{}", 1.0, None)], "log_id string, seq bigint, doc_id string, raw_output string, latency_ms double, ts timestamp")), last + 1)
    tails = spark.read.parquet(str(tmp_path / "log_tails"))
    assert sorted((r.log_id, r.batch_id - last) for r in tails.collect()) == [("l0", 0), ("l0", 1), ("l1", 0), ("l1", 1)]
    got = {r.log_id: (r.ok, r.records) for r in review.verify_log(spark, str(tmp_path / "log")).collect()}
    assert got == {"l0": (True, 4), "l1": (True, 3)}


def test_windows(spark):
    events = spark.createDataFrame([("2025-01-01 00:10:00", "a", 1.0), ("2025-01-01 00:50:00", "a", 2.0), ("2025-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.total) for r in review.windowed(events).collect()) == [(1, 4.0), (2, 3.0)]


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    """The events in three files, and one event far ahead that closes all windows before it."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    folder = tmp_path / "in"
    events.repartition(3).write.parquet(str(folder))
    last = events.agg(F.max("ts") + F.expr("interval 9 days")).first()[0]
    spark.createDataFrame([(last, "end", 0.0)], events.schema).write.mode("append").parquet(str(folder))
    closing = review.windowed(spark.readStream.schema(events.schema).parquet(str(folder)), late="1 hour")
    closing.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out")).where("event_type != 'end'")) == key(review.windowed(events))


def _row(i, log=None):
    return {"log_id": log or f"l{i % 2}", "seq": i, "doc_id": f"d{i}", "raw_output": "{}", "latency_ms": 1.0, "ts": "2025-01-01T00:00:00"}


def _chains(spark, log):
    return {r.log_id: (r.ok, r.records) for r in chains.verify(spark, str(log)).collect()}


def test_chain_state_is_keyed_and_a_batch_touches_its_own_logs(spark, tmp_path):
    folder, log, cp = tmp_path / "in", tmp_path / "log", tmp_path / "cp"
    folder.mkdir()
    _land(folder, "a.json", [_row(i, f"l{i}") for i in range(40)] + [_row(3, "l3"), _row(99, None) | {"log_id": None}])
    chains.start(spark, str(folder), str(log), str(cp)).awaitTermination()
    # logs again, out of order, one document seen before
    _land(folder, "b.json", [_row(51, "l7"), _row(50, "l7"), _row(7, "l7"), _row(52, "new") | {"doc_id": None}, _row(53, "new") | {"doc_id": None}])
    query = chains.start(spark, str(folder), str(log), str(cp))
    query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] >= 120 and max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress) <= 16
    chains.start(spark, str(folder), str(log), str(cp)).awaitTermination()
    rows = chains.log_rows(spark, str(log))
    (told,) = chains.receipts(spark, str(log)).where("doc_id = 'd51'").collect()
    assert told.n == 3 and len(told.record_hash) == len(told.prev_hash) == 64
    assert [r.seq for r in rows.where("log_id = 'l7'").orderBy("n").collect()] == [7, 50, 51] and rows.count() == 44
    got = _chains(spark, log)
    assert len(got) == 41 and got["l7"] == (True, 3) and got["new"] == (True, 2) and all(ok for ok, _ in got.values())


@pytest.mark.parametrize("moment", ["before", "after"])
def test_a_batch_killed_around_its_commit_is_there_once(spark, tmp_path, moment):
    folder, log, cp = tmp_path / "in", tmp_path / "log", tmp_path / "cp"
    folder.mkdir()
    mark = str(tmp_path / "killed")

    class Killed(committed_log.LogWriter):
        def commit(self, messages, batchId):
            import os

            if moment == "after":
                super().commit(messages, batchId)
            if batchId and any(m is not None and m.files for m in messages) and not os.path.exists(mark):
                open(mark, "w").close()
                os._exit(9)
            if moment == "before":
                super().commit(messages, batchId)

    class Source(committed_log.CommittedLog):
        def streamWriter(self, schema, overwrite):
            return Killed(self.options["path"])

    _land(folder, "a.json", [_row(i) for i in range(4)])
    chains.start(spark, str(folder), str(log), str(cp), source=Source).awaitTermination()
    _land(folder, "b.json", [_row(i) for i in range(2, 10)])
    with pytest.raises(Exception):  # noqa: B017
        chains.start(spark, str(folder), str(log), str(cp), source=Source).awaitTermination()
    assert chains.log_rows(spark, str(log)).count() == (4 if moment == "before" else 10)
    _land(folder, "c.json", [_row(i) for i in range(9, 12)])
    chains.start(spark, str(folder), str(log), str(cp), source=Source).awaitTermination()
    rows = chains.log_rows(spark, str(log)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(f"d{i}" for i in range(12))
    assert _chains(spark, log) == {"l0": (True, 6), "l1": (True, 6)}
    named = {f["name"] for _, files in committed_log.commits(str(log)) for f in files}
    assert sum(sum(1 for _ in open(log / "data" / f)) for f in named) == 12
    # a lost line, an edited one
    path = next(log / "data" / f for f in named if len((log / "data" / f).read_text().splitlines()) > 1)
    text = path.read_text()
    path.write_text("\n".join(text.splitlines()[1:]) + "\n")
    assert not all(ok for ok, _ in _chains(spark, log).values())
    path.write_text(text.replace('\\"latency_ms\\": 1.0', '\\"latency_ms\\": 2.0', 1))
    assert not all(ok for ok, _ in _chains(spark, log).values())


def test_idle_logs_are_closed_and_open_another_volume(spark, tmp_path):
    folder, log, cp = tmp_path / "in", tmp_path / "log", tmp_path / "cp"
    folder.mkdir()
    _land(folder, "a.json", [_row(0), _row(1), _row(2)])
    chains.start(spark, str(folder), str(log), str(cp), idle_ms=1).awaitTermination()
    time.sleep(1.1)
    _land(folder, "b.json", [_row(11)])
    chains.start(spark, str(folder), str(log), str(cp), idle_ms=1).awaitTermination()
    time.sleep(1.1)
    _land(folder, "c.json", [_row(20)])
    chains.start(spark, str(folder), str(log), str(cp), idle_ms=1).awaitTermination()
    got = chains.verify(spark, str(log)).collect()
    assert all(r.ok for r in got) and sum(r.closed for r in got) >= 2
    assert {r.volume for r in got} >= {"l0/2025-01-01T00:00:00.000000+00:00/0", "l0/2025-01-01T00:00:00.000000+00:00/20"}
    assert sorted(r.doc_id for r in chains.log_rows(spark, str(log)).where("doc_id is not null").collect()) == ["d0", "d1", "d11", "d2", "d20"]


def test_commits_are_listed_now_and_then(tmp_path, monkeypatch):
    monkeypatch.setattr(committed_log, "LIST_EVERY", 3)
    writer = committed_log.LogWriter(str(tmp_path))
    for batch in range(8):
        writer.commit([committed_log.Written([{"name": f"f{batch}"}]), None], batch)
    assert [(b, [f["name"] for f in files]) for b, files in committed_log.commits(f"file://{tmp_path}")] == [(b, [f"f{b}"]) for b in range(8)]
    for old in range(6):
        (tmp_path / "_commits" / f"{old:012d}.json").unlink()
    assert [b for b, _ in committed_log.commits(str(tmp_path))] == list(range(8))


def test_files_of_lost_tasks_are_cleared_away(tmp_path):
    writer = committed_log.LogWriter(str(tmp_path))
    (tmp_path / "data").mkdir()
    for name in ("kept.jsonl", "lost.jsonl"):
        (tmp_path / "data" / name).write_text("{}\n")
    writer.commit([committed_log.Written([{"name": "kept.jsonl"}])], 0)
    assert committed_log.vacuum(str(tmp_path)) == []
    assert committed_log.vacuum(str(tmp_path), hours=-1) == ["lost.jsonl"] and [p.name for p in (tmp_path / "data").iterdir()] == ["kept.jsonl"]
    assert committed_log.vacuum(str(tmp_path / "none"), hours=-1) == []
