"""Live samples beside their gold labels, null where there is none yet.

Gold arrives as lines of JSON files while the stream runs. Before each micro-batch the index of these files takes in
what was added (:mod:`..sources.line_index`); then only the batch's own documents are looked up, and only their lines
are read. So a batch's work follows the batch and what is new, not all gold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources import line_index


def beside_gold(samples: DataFrame, index: str, label: str = schemas.LABEL) -> DataFrame:
    """samples (doc_id and more) with the column gold, a struct by the DDL ``label``; null where no gold is indexed.

    Of several labels of a document the last written counts. A sample without a doc_id has no gold.
    """
    places = line_index.joined(samples.sparkSession, index, samples.select(F.col("doc_id").alias("key")))
    found = line_index.records(places).select(F.col("key").alias("_key"), F.from_json("line", label).alias("gold"))
    return samples.join(found, F.col("doc_id") == F.col("_key"), "left").drop("_key")


def live(spark: SparkSession, samples: DataFrame, gold: str, index: str, out: str, checkpoint: str, label: str = schemas.LABEL) -> StreamingQuery:
    """Write each micro-batch of the stream ``samples`` beside its gold to ``out``; a batch that comes again replaces its rows."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        line_index.build(batch.sparkSession, gold, index)
        rows = beside_gold(batch, index, label).withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    return samples.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
