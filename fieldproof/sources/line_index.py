"""An index of JSON Lines files by key: byte ranges as a sorted table, and reads of just those ranges.

The index holds (key, file, start, length, at): where each record's line stands. It is built by tasks that each read a
range of a file, and only what was added since the last time is read: appended bytes of known files, and new files. A
file that is shorter than what was indexed has been replaced, and an error says so. Written in ranges of keys and sorted within, so a
lookup of some keys prunes to the row groups that hold them, and then opens the named ranges. Of several records of a
key the last one wins: the later file by name, then the later line.

Files are plain UTF-8 without a byte order mark; lines end with a line feed, and a last line without one is left for
the next time, as its writer may not be done.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, store

RANGE_BYTES = 32 << 20
_INDEX = "key string, file string, start long, length long, done long"


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the files of a glob, in name order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted((x.getPath().toString(), x.getLen()) for x in found if x.isFile())


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, line) of each whole line that begins in its range (file, start, stop, size)."""
    for batch in batches:
        for part in batch.to_pylist():
            system, path = store.opened(part["file"])
            with system.open_input_file(path) as f:
                at, stop = part["start"], part["stop"]
                if part["start"] > part["begin"]:  # the line that reaches into the range is the one before's
                    f.seek(at - 1)
                    at += len(_rest(f)) - 1
                f.seek(at)
                held, rows, size = [], [], 0
                while at < stop:
                    block = f.read(1 << 20)
                    first, *more = block.split(b"\n")
                    held.append(first)
                    whole = [b"".join(held), *more[:-1]] if more else []
                    held = more[-1:] or held
                    for line in whole:
                        if at >= stop:
                            break
                        rows.append((part["file"], at, line))
                        at, size = at + len(line) + 1, size + len(line)
                    if size > 4 << 20 or at >= stop or not block:
                        yield _batch(rows)
                        rows, size = [], 0
                    if not block:
                        break


def _rest(f) -> bytes:
    """The bytes up to the next line feed, that included."""
    out = b""
    while block := f.read(1 << 16):
        head, found, _ = block.partition(b"\n")
        out += head + found
        if found:
            break
    return out


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    file, start, line = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array(line, pa.binary())], names=["file", "start", "line"])


def _placed(spark: SparkSession, ranges: Sequence[tuple[str, int, int, int]], key: str) -> DataFrame:
    """(key, file, start, length) of the lines of ranges (file, begin, start, stop)."""
    work = spark.createDataFrame(list(ranges), "file string, begin long, start long, stop long").repartition(max(1, len(ranges)), "file", "start")
    text = F.col("line").cast("string")
    return work.mapInArrow(_lines, "file string, start long, line binary").where(F.trim(text) != "").select(
        F.get_json_object(text, f"$.{key}").alias("key"), "file", "start", F.octet_length("line").cast("long").alias("length"))


def build(spark: SparkSession, path: str, index: str, key: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Index what the files of the glob ``path`` hold beyond the index, and return all of it.

    Each call adds a generation (a folder ``generation=n``) with its own sorted files. Records without a key, or that
    are no JSON, stand under a null key, which no lookup finds; blank lines have no row. Nothing new, nothing written.
    """
    known: dict[str, int] = {}
    last = -1
    if files.exists(spark, index):
        have = _all(spark, index)
        known = {r.file: r.done for r in have.groupBy("file").agg(F.max("done").alias("done")).collect()}
        last = have.agg(F.max("generation")).first()[0]
    work = []
    for file, size in _listed(spark, path):
        begin = known.get(file, 0)
        if size < begin:
            raise ValueError(f"{file} is shorter than what was indexed of it")
        work += [(file, begin, at, min(size, at + range_bytes)) for at in range(begin, size, range_bytes)]
    if work:
        rows = _placed(spark, work, key).withColumn("done", F.col("start") + F.col("length") + 1)
        folder = posixpath.join(index, f"generation={last + 1}")
        rows.repartitionByRange("key", "file", "start").sortWithinPartitions("key", "file", "start").write.mode("overwrite").parquet(folder)
    return _all(spark, index)


def _all(spark: SparkSession, index: str) -> DataFrame:
    """All generations; none where nothing has been indexed yet."""
    if not files.exists(spark, index):
        return spark.createDataFrame([], f"{_INDEX}, generation int")
    return spark.read.schema(f"{_INDEX}, generation int").parquet(index)


def lookup(spark: SparkSession, index: str, keys: Sequence[str]) -> DataFrame:
    """(key, file, start, length) of the last record of each key; keys that aren't there have no row.

    The keys stand in the filter, so whole row groups and files without them are passed over.
    """
    return _last(_all(spark, index).where(F.col("key").isin(list(keys))))


def joined(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """As :func:`lookup`, for any number of keys in a table (key)."""
    return _last(_all(spark, index).join(keys.select("key").distinct(), "key", "left_semi"))


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max(F.struct("file", "start", "length")).alias("r")).select("key", "r.*")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        opened: dict[str, object] = {}
        lines = []
        for file, start, length in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "length")]):
            if file not in opened:
                system, path = store.opened(file)
                opened[file] = system.open_input_file(path)
            lines.append(opened[file].read_at(length, start).decode())
        for f in opened.values():
            f.close()
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lines, pa.string())], names=["key", "line"])


def records(places: DataFrame, partitions: int | None = None) -> DataFrame:
    """(key, line) of the places: each task reads the ranges that are its own, in order of the files, and nothing else."""
    ordered = places.select("key", "file", "start", "length").repartitionByRange(partitions or places.sparkSession.sparkContext.defaultParallelism, "file", "start").sortWithinPartitions("file", "start")
    return ordered.mapInArrow(_read, "key string, line string")
