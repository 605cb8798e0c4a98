"""Files by URI for code in Spark's Python workers: local paths, ``file:``, ``hdfs:`` and ``s3:`` alike."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow.fs as fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """A file that is there whole or not at all: written beside its place, then moved to it."""
    system.create_dir(posixpath.dirname(path), recursive=True)
    beside = posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.{uuid.uuid4().hex}")
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, path)


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def names(system: fs.FileSystem, folder: str) -> list[str]:
    """Names of a folder's files, sorted; none where it doesn't exist. Hidden files are left out."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == fs.FileType.File and not x.base_name.startswith("."))
