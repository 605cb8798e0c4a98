"""Tables that several reports read, written once a session to a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], str] = {}


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name, made and written at its first use in a session; it goes when the JVM ends."""
    return spark.read.parquet(_path(spark, name, lambda path: make().write.parquet(path)))


def is_made(spark: SparkSession, name: str) -> bool:
    """Whether :func:`once` has made the table of this name in this session."""
    return (spark.sparkContext.applicationId, name) in _made


def once_json(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> str:
    """The folder of the JSON Lines files of this name, as :func:`once`."""
    return _path(spark, name, lambda path: make().write.json(path))


def once_folder(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The folder that ``write`` has filled, as :func:`once`."""
    return _path(spark, name, write)


def _path(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    key = spark.sparkContext.applicationId, name
    if key not in _made:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir is not set: working tables need a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="fieldproof-")
        path = f"{folder.rstrip('/')}/working-{uuid.uuid4().hex}"
        write(path)
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
        _made[key] = path
    return _made[key]
