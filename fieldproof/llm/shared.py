"""Working tables in the folder that driver and executors share, and connected components over DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on a single machine (tests), a new local one.

    On a cluster a local folder would be another one on each machine, so there the setting is asked for.
    """
    jsc = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: working tables need a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldproof-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes with :func:`discard`, or when the session's JVM ends. A join has its aggregated side stored first
    where a key may be hot: adaptive execution splits a skewed join only between plain shuffles.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node id reachable over the undirected edges (u, v).

    Alternates the large-star and small-star steps, which shorten chains exponentially; each round is written to the
    shared folder and the one before it deleted. Nodes without an edge don't appear; nulls and loops are dropped. A
    hub's links are aggregated in parts, and joined to the stored result, so that they can be split.
    """
    pairs = stored(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # here a node meets only its smaller neighbours
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        link = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after = stored(large.join(least, "u").select(F.explode(link).alias("p")).select("p.*").where("u != v").distinct(), "links")
        discard(pairs, low, large, least)
        pairs = after
        now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(v % 1000003)")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: no end after all rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 8 MB at most go to Python workers (one longer text makes a batch), where the session has Spark's 64 MB."""
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "8m")


def text_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text), so that other columns, whatever their names, neither clash nor travel.

    Ids are whole numbers; any other text in the id column raises Spark's cast error.
    """
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
