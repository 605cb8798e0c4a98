"""Hash-chained audit logs: sequenced scan, parallel verification, resume, and appends.

Every record stores its predecessor's hash, so verification needs no walk: the link test is a lag over blocks of the
log's order, the content test is a hash of the row alone. Appending is a fold, one log after the other being independent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GENESIS

#: Lines of a log that one task links at least, where logs are long.
BLOCK_LINES = 1 << 16


def canonical(record: dict) -> str:
    """JSON with sorted keys, no spaces, and characters as they are: what is hashed."""
    return json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def record_hash(record: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in record.items() if k != "record_hash"}).encode()).hexdigest()


def _read(lines: pd.Series) -> pd.DataFrame:
    def one(line: str) -> tuple:
        try:
            rec = json.loads(line)
            return rec.get("prev_hash"), rec.get("record_hash"), record_hash(rec), rec.get("doc_id")
        except (ValueError, AttributeError, TypeError):
            return None, None, None, None

    return pd.DataFrame([one(x) for x in lines], columns=["prev_hash", "record_hash", "computed_hash", "doc_id"])


def opened(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines (log_id, line_no, line) with what the chain needs; blank lines are skipped."""
    struct = "struct<prev_hash: string, record_hash: string, computed_hash: string, doc_id: string>"
    some = lines.where(F.trim(F.regexp_replace(line_col, r"\s", "")) != "")
    return some.withColumn("r", F.pandas_udf(_read, struct)(F.col(line_col))).select(*lines.columns, "r.*")


def links(records: DataFrame, log_col: str = "log_id", order_col: str = "line_no", block: Column | None = None) -> DataFrame:
    """(log, records, bad) per log of records (prev_hash, record_hash, computed_hash): bad (at, link) is the first failing
    row and whether its link holds; null where all hold.

    A long log is cut in blocks of order values (``block``, which must rise with the order). Rows are linked within each;
    then a row per block, with its first link and last hash, is linked to the block before.
    """
    return joined_blocks(linked_blocks(records, log_col, order_col, block), log_col)


def linked_blocks(records: DataFrame, log_col: str = "log_id", order_col: str = "line_no", block: Column | None = None) -> DataFrame:
    """(log, _block, records, bad, start, opens, ends) per block: its rows linked within it."""
    block = F.floor(F.col(order_col) / BLOCK_LINES) if block is None else block
    rows = records.withColumn("_block", block)
    rows = rows.withColumn("_before", F.lag(F.struct("record_hash")).over(Window.partitionBy(log_col, "_block").orderBy(order_col)))
    link = F.col("_before").isNull() | F.coalesce(F.col("prev_hash") == F.col("_before.record_hash"), F.lit(False))
    content = F.coalesce(F.col("record_hash") == F.col("computed_hash"), F.lit(False))
    bad = F.when(~link | ~content, F.struct(F.col(order_col).alias("at"), link.alias("link")))
    return rows.groupBy(log_col, "_block").agg(
        F.count("*").alias("records"), F.min(bad).alias("bad"), F.min(order_col).alias("start"), F.min_by("prev_hash", order_col).alias("opens"), F.max_by("record_hash", order_col).alias("ends"))


def joined_blocks(blocks: DataFrame, log_col: str = "log_id") -> DataFrame:
    """(log, records, bad) per log of rows of :func:`linked_blocks`: each block linked to the one before."""
    blocks = blocks.withColumn("_before", F.lag(F.struct("ends")).over(Window.partitionBy(log_col).orderBy("_block")))
    tail = F.when(F.col("_before").isNull(), GENESIS).otherwise(F.col("_before.ends"))
    joint = F.when(~F.coalesce(F.col("opens") == tail, F.lit(False)), F.struct(F.col("start").alias("at"), F.lit(False).alias("link")))
    return blocks.groupBy(log_col).agg(F.sum("records").alias("records"), F.min(F.least("bad", joint)).alias("bad"))


def verify_again(lines: DataFrame, known: DataFrame | None = None, log_col: str = "log_id", order_col: str = "line_no", block_lines: int = BLOCK_LINES) -> tuple[DataFrame, DataFrame]:
    """(verdicts, blocks): as :func:`verify`, but blocks that ``known`` holds as verified aren't parsed and hashed again.

    ``known`` is the blocks table of an earlier call. Each block's lines are digested as they stand, by hashes in the
    JVM; a block whose digest and count are known is trusted, any other one (new, grown or edited) is verified in full.
    So an edit in an old block is found, and appends cost their own blocks. Blocks that fail are never known. Keep both
    results before the lines change: they are read lazily.
    """
    block = F.floor(F.col(order_col) / block_lines)
    placed = lines.where(F.trim(F.regexp_replace("line", r"\s", "")) != "").withColumn("_block", block)
    digest = F.sum(F.xxhash64(order_col, "line").cast("decimal(19, 0)")).alias("digest")
    now = placed.groupBy(log_col, "_block").agg(F.count("*").alias("_lines"), digest)
    fresh = placed if known is None else placed.join(now.join(known, [log_col, "_block", "_lines", "digest"], "left_anti").select(log_col, "_block"), [log_col, "_block"], "left_semi")
    tested = linked_blocks(opened(fresh.drop("_block")), log_col, order_col, block).join(now, [log_col, "_block"])
    if known is not None:
        tested = tested.unionByName(known.join(now, [log_col, "_block", "_lines", "digest"], "left_semi"))
    return _told(joined_blocks(tested, log_col), log_col), tested.where("bad is null")


def verify(lines: DataFrame, log_col: str = "log_id", order_col: str = "line_no") -> DataFrame:
    """(log, ok, bad_line, message, records) per log; the first failing line is told, the link before the contents."""
    return _told(links(opened(lines), log_col, order_col), log_col)


def _told(made: DataFrame, log_col: str) -> DataFrame:
    text = (
        F.when(F.col("bad").isNull(), F.concat(F.lit("OK -- "), F.col("records").cast("string"), F.lit(" records, chain intact")))
        .when(~F.col("bad.link"), F.concat(F.lit("line "), F.col("bad.at").cast("string"), F.lit(": previous-hash link broken (a record was removed or reordered)")))
        .otherwise(F.concat(F.lit("line "), F.col("bad.at").cast("string"), F.lit(": record contents were modified"))))
    return made.select(log_col, F.col("bad").isNull().alias("ok"), F.col("bad.at").alias("bad_line"), text.alias("message"), "records")


def last_hash(records: DataFrame, log_col: str = "log_id", order_col: str = "line_no") -> DataFrame:
    """(log, record_hash) of each log's last record."""
    return records.groupBy(log_col).agg(F.max_by("record_hash", order_col).alias("record_hash"))


def remaining(manifest: DataFrame, records: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The manifest's rows that the log lacks."""
    return manifest.join(records.select(id_col).distinct(), id_col, "left_anti")


def appended(new: DataFrame, tails: DataFrame | None = None, log_col: str = "log_id", order_col: str = "seq", payload_col: str = "record") -> DataFrame:
    """(log, seq, line): new records (log, seq, record as JSON, timestamp inside) chained after each log's tail.

    One log is a sequential fold by nature, so it is one group that streams through a task in order; logs are parallel.
    """
    joined = new if tails is None else new.join(tails.select(F.col(log_col), F.col("record_hash").alias("tail")), log_col, "left")
    joined = joined.withColumn("tail", F.coalesce("tail", F.lit(GENESIS))) if tails is not None else joined.withColumn("tail", F.lit(GENESIS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, prev = None, GENESIS
        for frame in frames:
            out = []
            for key, seq, record, tail in zip(frame[log_col], frame[order_col], frame[payload_col], frame["tail"]):
                if key != log:
                    log, prev = key, tail
                rec = json.loads(record) | {"prev_hash": prev}
                prev = rec["record_hash"] = record_hash(rec)
                out.append((key, seq, json.dumps(rec, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=[log_col, order_col, "line"])

    kinds = {f.name: f.dataType.simpleString() for f in new.schema}
    ordered = joined.select(log_col, order_col, payload_col, "tail").repartition(log_col).sortWithinPartitions(log_col, order_col)
    return ordered.mapInPandas(run, f"`{log_col}` {kinds[log_col]}, `{order_col}` {kinds[order_col]}, line string")


def folded_chain(steps: Column, genesis: str = GENESIS) -> Column:
    """The last hash of a chain over an ordered array of texts, wholly in SQL: h = sha256(previous h + text)."""
    return F.aggregate(steps, F.lit(genesis), lambda h, x: F.sha2(F.concat(h, x), 256))
