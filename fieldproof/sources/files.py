"""Scans of manifests, labels, logs, runs and cards; schemas are explicit and a missing path is an empty table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from . import store


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _read(spark: SparkSession, path: str, schema: str, whole_file: bool = False) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return (reader.option("multiLine", True) if whole_file else reader).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, line): physical lines from 1 within each file; blank ones keep their numbers.

    A large file is read in blocks: lines are numbered within each, and the blocks' counts, a row per block, are added
    up before them.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "log_id string, line_no int, line string")
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    sizes = raw.groupBy("log_id", "block").agg(F.count("*").alias("n"))
    before = sizes.select("log_id", "block", (F.sum("n").over(Window.partitionBy("log_id").orderBy("block")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("log_id", "block").orderBy("at"))
    return raw.withColumn("own", own).join(before, ["log_id", "block"]).select("log_id", (F.col("before") + F.col("own")).cast("int").alias("line_no"), "line")


def manifest(spark: SparkSession, split_dir: str) -> DataFrame:
    """The manifest; of repeated doc_ids the last line counts, in the place of the first (column seq)."""
    lines = numbered_lines(spark, f"{split_dir}/manifest.jsonl").where(F.trim("line") != "")
    rows = lines.select("line_no", F.from_json("line", schemas.MANIFEST).alias("m")).select("line_no", "m.*")
    w = Window.partitionBy("doc_id")
    last = rows.withColumns({"seq": F.min("line_no").over(w), "_last": F.max("line_no").over(w)})
    return last.where("line_no = _last").drop("line_no", "_last")


def labels(spark: SparkSession, split_dir: str) -> DataFrame:
    """All labels of a split (or of several, by glob), with the split they lie in."""
    path = f"{split_dir}/labels/*.json"
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.LABEL).withColumn("split", F.lit(None).cast("string"))
    return spark.read.schema(schemas.LABEL).option("multiLine", True).json(path).withColumn("split", F.element_at(F.split("_metadata.file_path", "/"), -3))


def label_of(found: DataFrame, doc_id: str) -> DataFrame:
    """The label of one document: of several splits the first by name."""
    return found.where(F.col("doc_id") == doc_id).orderBy("split").limit(1)


def missing_labels(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.select("doc_id"), "doc_id", "left_anti")


def audit(spark: SparkSession, run_dir: str) -> DataFrame:
    """Records of audit logs with their order; unknown keys are left in the line."""
    lines = numbered_lines(spark, f"{run_dir}/audit.jsonl").where(F.trim("line") != "")
    return lines.select("log_id", F.col("line_no").alias("seq"), "line", F.from_json("line", schemas.AUDIT).alias("r")).select("log_id", "seq", "line", "r.*")


def run_configs(spark: SparkSession, runs_dir: str) -> DataFrame:
    return _with_dir(_read(spark, f"{runs_dir}/*/config.json", schemas.RUN_CONFIG, True))


def run_metrics(spark: SparkSession, runs_dir: str, schema: str = schemas.RUN_METRICS) -> DataFrame:
    """Metrics of all runs with their folder and path, for last-by-path choices."""
    return _with_dir(_read(spark, f"{runs_dir}/*/metrics.json", schema, True))


def training_cards(spark: SparkSession, adapters_dir: str) -> DataFrame:
    return _with_dir(_read(spark, f"{adapters_dir}/*/training_card.json", schemas.TRAINING_CARD, True))


def _with_dir(rows: DataFrame) -> DataFrame:
    if not rows.inputFiles():
        return rows.withColumns({"_path": F.lit(None).cast("string"), "_dir": F.lit(None).cast("string")})
    return rows.withColumns({"_path": F.col("_metadata.file_path"), "_dir": F.element_at(F.split("_metadata.file_path", "/"), -2)})


def dataset_hash(spark: SparkSession, data_dir: str, split: str) -> str:
    path = f"{data_dir}/dataset_info.json"
    if not exists(spark, path):
        return "unknown"
    row = spark.read.schema("split_hashes map<string, string>").option("multiLine", True).json(path).select(F.try_element_at("split_hashes", F.lit(split)).alias("h")).first()
    return row.h if row and row.h else "unknown"


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def adapter_fingerprint(spark: SparkSession, folder: str, block: int = 8 << 20) -> str:
    """Sixteen hex digits over the adapter's weight files in name order, read by one worker in blocks of bytes.

    The digest of one stream is sequential by nature; what a worker holds is a block, however large the files are.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/adapter_model*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    paths = sorted(x.getPath().toString() for x in found if x.isFile())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for many in batch.column("paths").to_pylist():
                made = hashlib.sha256()
                for uri in many:
                    system, path = store.opened(uri)
                    with system.open_input_stream(path) as f:
                        while data := f.read(block):
                            made.update(data)
                yield pa.RecordBatch.from_arrays([pa.array([made.hexdigest()])], names=["h"])

    return spark.createDataFrame([(paths,)], "paths array<string>").mapInArrow(fold, "h string").first().h[:16]
