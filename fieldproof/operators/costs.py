"""Cost per document from logged latencies and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded


def run_cost(records: DataFrame, keys: tuple[str, ...] = ("run_id",), gpu_hourly: float | None = None, in_price: float | None = None, out_price: float | None = None) -> DataFrame:
    """A row per run. With both a GPU price and token prices, the token figures count; without data a figure is null."""
    made = records.groupBy(*keys).agg(
        F.count("*").alias("docs"), F.median("latency_ms").alias("median_ms"), F.avg("latency_ms").alias("mean_ms"), F.avg("input_tokens").alias("tokens_in"), F.avg("output_tokens").alias("tokens_out"))
    gpu = F.lit(None).cast("double") if gpu_hourly is None else F.lit(gpu_hourly) * F.col("mean_ms") / 1000 / 3600
    api = F.lit(None).cast("double") if in_price is None or out_price is None else F.col("tokens_in") / 1e6 * in_price + F.col("tokens_out") / 1e6 * out_price
    each = F.coalesce(api, gpu)
    return made.select(
        *keys, "docs", rounded(F.col("median_ms") / 1000, 1).alias("latency_s_p50"), rounded(each, 5).alias("usd_per_doc"), rounded(each * 1000, 2).alias("usd_per_1000_docs"),
        rounded(api * 500, 2).alias("batch_api_usd_per_1000_docs"), rounded(F.col("tokens_in"), 0).cast("long").alias("input_tokens_mean"), rounded(F.col("tokens_out"), 0).cast("long").alias("output_tokens_mean"))
