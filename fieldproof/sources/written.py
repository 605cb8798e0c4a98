"""Files that executors write and the driver commits, as Python data sources: a file per key, and one file in order.

``keyed_files`` writes each row (key, text) to a file of its own in a folder beside the target, which takes the target's
place when all tasks have ended: a job that fails leaves the target as it was. ``one_file`` writes each partition's
lines to a part; the commit joins the parts in the order of their partitions, by blocks of bytes, to one file, or adds
them to the end of one.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import store

BLOCK = 8 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    rows: int
    name: str = ""


class _KeyedWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, suffix: str) -> None:
        self.uri, self.suffix, self.beside = uri.rstrip("/"), suffix, f".{uuid.uuid4().hex}.writing"

    def _folder(self) -> tuple[fs.FileSystem, str]:
        system, path = store.opened(self.uri)
        return system, posixpath.join(posixpath.dirname(path), f"{posixpath.basename(path)}{self.beside}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        rows, last = 0, None
        for batch in iterator:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not key or "/" in key or key.startswith("."):
                    raise ValueError(f"no file can have the name {key!r}")
                if key == last:
                    raise ValueError(f"{key} has more than one row")
                store.put(system, posixpath.join(folder, key + self.suffix), (text or "").encode())
                rows, last = rows + 1, key
        return Part(TaskContext.get().partitionId(), rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = self._folder()
        _, path = store.opened(self.uri)
        system.create_dir(folder, recursive=True)
        if store.exists(system, path):
            system.move(path, f"{folder}.before")
        system.move(folder, path)
        if store.exists(system, f"{folder}.before"):
            system.delete_dir(f"{folder}.before")

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = self._folder()
        if store.exists(system, folder):
            system.delete_dir(folder)


class _OneFileWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, append: bool) -> None:
        self.uri, self.append, self.beside = uri, append, f".{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, path = store.opened(self.uri)
        part = Part(TaskContext.get().partitionId(), 0, f"{uuid.uuid4().hex}")
        system.create_dir(path + self.beside, recursive=True)
        with system.open_output_stream(posixpath.join(path + self.beside, part.name)) as out:
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                out.write("".join(f"{line}\n" for line in lines).encode())
                part.rows += len(lines)
        return part

    def commit(self, messages: list[Part | None]) -> None:
        system, path = store.opened(self.uri)
        whole = f"{path}.{uuid.uuid4().hex}.whole"
        names = [posixpath.join(path + self.beside, m.name) for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition)]
        if self.append and store.exists(system, path):
            names.insert(0, path)
        with system.open_output_stream(whole) as out:
            for name in names:
                with system.open_input_stream(name) as part:
                    while block := part.read(BLOCK):
                        out.write(block)
        system.move(whole, path)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        system, path = store.opened(self.uri)
        if store.exists(system, path + self.beside):
            system.delete_dir(path + self.beside)


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return "key string, text string"

    def writer(self, schema, overwrite: bool) -> _KeyedWriter:
        return _KeyedWriter(self.options["path"], self.options.get("suffix", ""))


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> _OneFileWriter:
        return _OneFileWriter(self.options["path"], not overwrite)


def keyed_files(rows: DataFrame, key: str, text: str, folder: str, suffix: str = ".json") -> None:
    """A file ``key + suffix`` per row in the folder, in place of what it held. A key on two rows is an error."""
    rows.sparkSession.dataSource.register(KeyedFiles)
    out = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    out.repartition("key").sortWithinPartitions("key").write.format("keyed_files").option("suffix", suffix).mode("overwrite").save(folder)


def one_file(rows: DataFrame, line: str, path: str, order: list[str], append: bool = False) -> None:
    """The rows' lines in order as one file, or after those that are there. A null line is an empty one.

    Tasks hold ranges of the order; the driver copies bytes, never rows.
    """
    rows.sparkSession.dataSource.register(OneFile)
    kept = rows.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.coalesce(F.col(line).cast("string"), F.lit("")).alias("line"))
    by = [f"_{i}" for i in range(len(order))]
    out = kept.repartitionByRange(*by).sortWithinPartitions(*by).select("line")
    out.write.format("one_file").mode("append" if append else "overwrite").save(path)
