"""A log of JSON lines with commits of its own, as a Python data source for streams and batch reads.

Tasks write files under ``data/``, each under a new name. The driver commits a micro-batch by one file under
``_commits/`` that names what belongs to it; a reader sees only files that a commit names. So a record is there once,
whatever is retried: files of a failed task or try are named nowhere, and a batch that was committed before its query
was killed keeps its first commit, while the files of its second run are deleted. Every hundredth commit also lists all
before it, so a reader opens at most a hundred of them.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.json as pj
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from . import store

SCHEMA = "log_id string, volume string, n bigint, seq bigint, doc_id string, line string, prev_hash string, record_hash string"
LIST_EVERY = 100
FILE_BYTES = 128 << 20
_ARROW = pa.schema([("log_id", pa.string()), ("volume", pa.string()), ("n", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.string()), ("line", pa.string()), ("prev_hash", pa.string()), ("record_hash", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class OneFile(InputPartition):
    name: str
    batch_id: int


def commits(uri: str) -> list[tuple[int, list[dict]]]:
    """(batch, its files) in order; from the last listing on, older ones by that."""
    system, path = store.opened(uri)
    folder = posixpath.join(path, "_commits")
    found = store.names(system, folder)
    listings = [x for x in found if x.endswith(".all.json")]
    out: list[tuple[int, list[dict]]] = []
    if listings:
        with system.open_input_stream(posixpath.join(folder, listings[-1])) as f:
            out = [(b, files) for b, files in json.loads(f.read())]
    known = {b for b, _ in out}
    for name in found:
        if not name.endswith(".all.json") and int(name.removesuffix(".json")) not in known:
            with system.open_input_stream(posixpath.join(folder, name)) as f:
                out.append((int(name.removesuffix(".json")), json.loads(f.read())))
    return sorted(out)


def vacuum(uri: str, hours: float = 24.0) -> list[str]:
    """Delete and name the files that no commit names and that are older than a running batch can be."""
    system, path = store.opened(uri)
    named = {f["name"] for _, files in commits(uri) for f in files}
    before = time.time() - hours * 3600
    found = system.get_file_info(fs.FileSelector(posixpath.join(path, "data"), allow_not_found=True))
    gone = sorted(x.base_name for x in found if x.type == fs.FileType.File and x.base_name not in named and x.mtime.timestamp() < before)
    for name in gone:
        system.delete_file(posixpath.join(path, "data", name))
    return gone


class LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Files of about FILE_BYTES; one that a lost task leaves behind is named by no commit."""
        system, path = store.opened(self.uri)
        files, out, rows = [], None, 0
        system.create_dir(posixpath.join(path, "data"), recursive=True)

        def close() -> None:
            nonlocal out
            if out is not None:
                files[-1] |= {"rows": rows, "bytes": out.tell()}
                out.close()
                out = None

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append({"name": f"{uuid.uuid4().hex}.jsonl"})
                    out, rows = system.open_output_stream(posixpath.join(path, "data", files[-1]["name"])), 0
                out.write(json.dumps(row, ensure_ascii=False).encode() + b"\n")
                rows += 1
                if out.tell() >= FILE_BYTES:
                    close()
        close()
        return Written(files)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, path = store.opened(self.uri)
        files = [f for m in messages if m is not None for f in m.files]
        place = posixpath.join(path, "_commits", f"{batchId:012d}.json")
        if store.exists(system, place):
            self._delete(files)  # committed by a try whose query ended before Spark wrote that down
            return
        store.put(system, place, json.dumps(files).encode())
        if batchId % LIST_EVERY == LIST_EVERY - 1:
            store.put(system, posixpath.join(path, "_commits", f"{batchId:012d}.all.json"), json.dumps(commits(self.uri)).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        """Also called where the commit failed after its file was written: what that names stays."""
        named = {f["name"] for b, files in commits(self.uri) if b == batchId for f in files}
        self._delete([f for m in messages if m is not None for f in m.files if f["name"] not in named])

    def _delete(self, files: list[dict]) -> None:
        system, path = store.opened(self.uri)
        for f in files:
            system.delete_file(posixpath.join(path, "data", f["name"]))


class LogReader(DataSourceReader):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def partitions(self) -> list[OneFile]:
        return [OneFile(f["name"], b) for b, files in commits(self.uri) for f in files] or [OneFile("", -1)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, path = store.opened(self.uri)
        with system.open_input_stream(posixpath.join(path, "data", partition.name)) as f:
            reader = pj.open_json(f, read_options=pj.ReadOptions(block_size=16 << 20), parse_options=pj.ParseOptions(explicit_schema=_ARROW))
            for batch in reader:
                yield batch.append_column("batch_id", pa.array([partition.batch_id] * batch.num_rows, pa.int64()))


class CommittedLog(DataSource):
    """``spark.read.format("committed_log").load(path)`` and ``writeStream.format("committed_log").start(path)``."""

    @classmethod
    def name(cls) -> str:
        return "committed_log"

    def schema(self) -> str:
        return f"{SCHEMA}, batch_id bigint"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a committed log is only appended to")
        if schema.names != _ARROW.names:
            raise ValueError(f"a committed log takes the columns {', '.join(_ARROW.names)}; these are {', '.join(schema.names)}")
        return LogWriter(self.options["path"])
