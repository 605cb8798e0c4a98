"""Writers, fingerprints, repeated verification, rewards of one's own, callbacks, bucketed tables."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from fieldproof import runs
from fieldproof.constants import IOU_THRESHOLD, REWARD_WEIGHTS
from fieldproof.operators import audit, generator, rewards, scoring
from fieldproof.plans import claims
from fieldproof.sources import bucketed, files, sinks, written

SF = "/root/testdata/sf0.001"


def test_ten_thousand_files_are_written_by_the_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    folder = tmp_path / "labels"
    rows = spark.range(10_000).select(F.format_string("d-%05d", "id").alias("k"), F.concat(F.lit("é"), F.col("id")).alias("t"))
    written.keyed_files(rows, "k", "t", str(folder))
    assert len(list(folder.iterdir())) == 10_000 and (folder / "d-00123.json").read_text() == "é123"
    # again with fewer: the folder is what was written last
    sinks.write_bundles(rows.limit(3).select(F.col("k").alias("doc_id"), F.col("t").alias("bundle")), str(folder))
    assert len(list(folder.iterdir())) == 3 and [p.name for p in tmp_path.iterdir()] == ["labels"]


@pytest.mark.parametrize("bad", [[("a", "1"), ("a", "2")], [("a", "1"), ("x/y", "2")], [("a", "1"), (None, "2")]])
def test_a_failed_write_leaves_the_target_as_it_was(spark, tmp_path, bad):
    folder = tmp_path / "labels"
    written.keyed_files(spark.createDataFrame([("old", "text")], "k string, t string"), "k", "t", f"file://{folder}")
    with pytest.raises(Exception, match="name|more than one"):
        written.keyed_files(spark.createDataFrame(bad, "k string, t string").repartition(3), "k", "t", str(folder))
    assert [p.name for p in folder.iterdir()] == ["old.json"] and [p.name for p in tmp_path.iterdir()] == ["labels"]


def test_one_file_is_in_order_and_is_added_to(spark, tmp_path):
    path = tmp_path / "sub" / "m.jsonl"
    path.parent.mkdir()
    lines = lambda low, high: spark.range(low, high).select("id", F.concat(F.lit("line "), "id").alias("line")).repartition(7)
    written.one_file(lines(0, 500), "line", str(path), ["id"])
    written.one_file(lines(500, 700), "line", str(path), ["id"], append=True)
    assert path.read_text() == "".join(f"line {i}\n" for i in range(700))
    written.one_file(lines(0, 0), "line", str(path), ["id"])
    assert path.read_text() == "" and [p.name for p in path.parent.iterdir()] == ["m.jsonl"]


def test_fingerprint_of_large_files(spark, tmp_path):
    whole = hashlib.sha256()
    for name, size in (("adapter_model-00002.bin", 1 << 20), ("adapter_model-00001.bin", 90 << 20), ("adapter_config.json", 10)):
        data = bytes([size % 251]) * size
        (tmp_path / name).write_bytes(data)
    for name in ("adapter_model-00001.bin", "adapter_model-00002.bin"):
        whole.update((tmp_path / name).read_bytes())
    assert files.adapter_fingerprint(spark, str(tmp_path), block=1 << 16) == whole.hexdigest()[:16]


def _log(n, edit=None, drop=None):
    prev, out = audit.GENESIS, []
    for i in range(n):
        rec = {"doc_id": f"d{i}", "v": i, "prev_hash": prev}
        prev = rec["record_hash"] = audit.record_hash(rec)
        out.append(("log", i + 1, json.dumps(rec | ({"v": -1} if i == edit else {}))))
    return [x for i, x in enumerate(out) if i != drop]


def test_a_second_verification_tests_new_and_changed_blocks(spark):
    frame = lambda rows: spark.createDataFrame(rows, "log_id string, line_no int, line string")
    told = lambda x: [(r.ok, r.bad_line, r.records) for r in x.collect()]
    seen = spark.sparkContext.accumulator(0)
    real = audit._read

    def counted(lines):
        seen.add(len(lines))
        return real(lines)

    audit._read = counted
    try:
        first, known = audit.verify_again(frame(_log(100)), None, block_lines=10)
        known = spark.createDataFrame(known.collect(), known.schema)
        assert told(first) == [(True, None, 100)] and known.count() == 11
        # lines 1 to 9 are the first block, 100 the last one, which grows
        for rows, expected, most in ((_log(120), (True, None, 120), 21), (_log(120, edit=41), (False, 42, 120), 31), (_log(120, drop=41), (False, 43, 119), 30), (_log(100), (True, None, 100), 0)):
            before = seen.value
            again, blocks = audit.verify_again(frame(rows), known, block_lines=10)
            assert told(again) == [expected]
            # one pass over what is tested, and nothing of the other blocks
            assert seen.value - before == most
            assert blocks.where("bad is not null").count() == 0
        # the tail is cut off: that shows in no chain
        assert told(audit.verify_again(frame(_log(100)[:95]), known, block_lines=10)[0]) == [(True, None, 95)]
    finally:
        audit._read = real
    assert audit.verify_again(frame([]), known)[0].collect() == []


def test_blocks_found_intact_are_kept_between_verifications(spark, tmp_path):
    log, known = tmp_path / "audit.jsonl", str(tmp_path / "known")
    put = lambda rows: log.write_text("".join(f"{line}\n" for _, _, line in rows))
    assert runs.verify_log(spark, str(log), known) is None
    for rows, ok in ((_log(30), True), (_log(45), True), (_log(45, edit=7), False), (_log(45), True)):
        put(rows)
        found = runs.verify_log(spark, str(log), known)
        assert (found.ok, found.records) == (ok, 45 if len(rows) == 45 else 30) and found.message == runs.verify_log(spark, str(log)).message
    assert sorted(p.name for p in (tmp_path / "known").iterdir()) == ["version=3", "version=4"]


def test_a_reward_of_ones_own(spark):
    def built_in(doc):
        """The built-in reward, from a document's rows."""
        if not doc.json_valid.iloc[0]:
            return 0.0
        present = doc[doc.gold_present]
        credit = [0.5 * r.evidence_supported + 0.5 * min(1.0, r.iou / IOU_THRESHOLD) if r.correct else 0.0 for r in present.itertuples()]
        parts = {"format": 1.0 if doc.schema_valid.iloc[0] else 0.5, "accuracy": doc.correct.mean(), "grounding": sum(credit) / len(credit) if credit else 1.0}
        return sum(REWARD_WEIGHTS[k] * v for k, v in parts.items())

    rows = claims.facts(spark, SF)
    own = {r.doc_id: r.reward for r in rewards.rewarded(rows, built_in).collect()}
    made = {r.doc_id: r.reward for r in scoring.document_scores(rows).collect()}
    assert len(own) == len(made) > 1000 and all(abs(own[d] - made[d]) <= 0.5001e-4 for d in made)
    rewards.reward("by name")(lambda doc: 1)
    assert {r.reward for r in rewards.rewarded(rows.where("doc_id = '1'"), "by name").collect()} == {1.0}
    with pytest.raises(ValueError, match="already"):
        rewards.reward("by name")(built_in)
    for f, where in ((lambda doc: float("nan"), "true"), (lambda doc: "much", "true"), (lambda doc: True, "true"), (built_in, "field_pos > 0")):
        with pytest.raises(Exception, match="document"):
            rewards.rewarded(rows.where("doc_id = '1'").where(where), f).collect()


def test_metrics_of_a_running_job_reach_a_callback(spark, tmp_path):
    told = []
    rows = claims.facts(spark, SF).where("doc_id in ('1', '2', '58')")
    watched, tell = rewards.observed(rows, told.append)
    watched.write.parquet(str(tmp_path / "out"))
    tell()
    assert told[0]["name"] == "scored" and told[0]["rows"] == 21 and told[0]["unparseable"] == 7 and 0 < told[0]["correct"] < 21
    same, nothing = rewards.observed(rows, None)
    assert same is rows and nothing() is None
    batches = []
    listener = rewards.BatchLog(batches.append, "mine")
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in/a.json").write_text('{"v": 1}\n{"v": 5}')
        stream = spark.readStream.schema("v int").json(str(tmp_path / "in")).observe("seen", F.max("v").alias("most"))
        stream.writeStream.queryName("mine").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if batches:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert batches[0] == {"name": "mine", "batch_id": 0, "rows": 2, "seen.most": 5}


def test_bucketed_sides_are_not_shuffled(spark, tmp_path):
    labels = generator.labels(generator.split_records(spark, "b", 20), generator.PLAIN_TYPES)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        made = bucketed.write(labels, str(tmp_path / "labels"), "labels_in_buckets", 4)
        listed = bucketed.write(generator.manifest(labels), str(tmp_path / "manifest"), "manifest_in_buckets", 4)
        spark.sql("drop table labels_in_buckets")
        made = bucketed.table(spark, str(tmp_path / "labels"), "labels_in_buckets", 4)
        outputs = spark.createDataFrame([(f"b-{i:05d}", "{}") for i in range(20)], "doc_id string, raw_output string")
        rows = scoring.score_with_meta(outputs, made, listed)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 2
        plain = scoring.with_meta(scoring.score(outputs, labels), generator.manifest(labels))
        key = lambda df: sorted(map(str, df.select("doc_id", "field", "error_type", "quality").collect()))
        assert key(rows) == key(plain) and rows.count() == 140
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
