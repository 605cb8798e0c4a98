"""Labels and manifests as tables bucketed by doc_id, from the small files they arrive in.

Scoring joins outputs to labels and rows to the manifest, all by doc_id. From bucketed tables these sides are read in
place: only the outputs are shuffled, to the buckets that are there. The step that makes a table reads each small file
once; :func:`table` registers what a folder holds with the session, which needs no catalogue of its own to live on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def write(rows: DataFrame, path: str, name: str, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """rows as parquet files in ``buckets`` buckets by key, sorted within, at path; the table of that name reads them."""
    spark = rows.sparkSession
    spark.sql(f"drop table if exists `{name}`")
    # a file per bucket: rows of a bucket meet in one task before they are written
    rows.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, path: str, name: str, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """The table at path, as :func:`write` left it, in another session; buckets and key must be the same."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"create table `{name}` ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'")
    return spark.table(name)
