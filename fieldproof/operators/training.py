"""Training sets and the monitors of a training run."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FIELDS
from ..functions.prompts import one_field_per_line
from ..functions.text import rounded


def _targets(golds: pd.Series) -> pd.Series:
    def one(gold) -> str:
        values = {}
        for name, f in zip(FIELDS, gold):
            values[name] = None if f is None else {"value": f["value"], "evidence_text": f["evidence_text"], "page": 1, "bbox": [int(round(float(x))) for x in f["bbox"]]}
        return one_field_per_line(values)

    return golds.map(one)


def target_text(gold):
    """The answer that is taught: a field per line, whole-number boxes, explicit nulls."""
    return F.pandas_udf(_targets, "string")(gold)


def examples(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, image_path, width, height, target, quality) per document."""
    from .scoring import gold_array

    return manifest.select("doc_id", "image", "quality").join(gold_array(labels).select("doc_id", "width", "height", "gold"), "doc_id").select(
        "doc_id", F.col("image").alias("image_path"), "width", "height", target_text(F.col("gold")).alias("target"), "quality")


def oversampled(rows: DataFrame, share: float | None = 0.35, seed: int = 0, quality: str = "poor") -> DataFrame:
    """rows plus copies of rows of that quality, drawn with replacement until they make up the share, in seeded order.

    Copies are named doc_id#dupN. A draw takes the row at a hashed position; positions are numbered within hashed
    blocks, so no task sees all rows.
    """
    out = rows
    if share:
        counts = rows.agg(F.count_if(F.col("quality") == quality).alias("poor"), F.count("*").alias("n")).first()
        extra = max(0, math.ceil(share * (counts.n - counts.poor) / (1 - share)) - counts.poor) if counts.poor else 0
        if extra:
            blocks = max(1, counts.poor // 10_000)
            of = rows.where(F.col("quality") == quality).withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
            sizes = of.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))  # a row per block
            place = of.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("doc_id"))).join(F.broadcast(sizes), "_b").withColumn("_at", F.col("_base") + F.col("_i") - 1)
            draws = rows.sparkSession.range(extra).select(F.col("id").alias("_dup"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(counts.poor)).alias("_at"))
            copies = draws.join(place, "_at").withColumn("doc_id", F.concat("doc_id", F.lit("#dup"), F.col("_dup").cast("string")))
            out = rows.unionByName(copies.select(*rows.columns))
    return shuffled(out, seed)


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")


def base_id(doc_id):
    return F.substring_index(doc_id, "#", 1)


def described(rows: DataFrame) -> DataFrame:
    """One row: examples, distinct documents, share of poor scans, absent fields."""
    poor = F.count_if(F.col("quality") == "poor") / F.nullif(F.count("*"), F.lit(0))
    return rows.agg(
        F.count("*").alias("n_examples"), F.countDistinct(base_id(F.col("doc_id"))).alias("unique_docs"),
        poor.alias("_poor"), F.coalesce(F.sum(F.regexp_count("target", F.lit(": null"))), F.lit(0)).alias("null_fields")).select(
        "n_examples", "unique_docs", F.coalesce(rounded(F.col("_poor"), 3), F.lit(0.0)).alias("poor_share"), "null_fields")


def advantages(rewards: DataFrame, keys: tuple[str, ...] = ("step",), least_std: float = 0.1) -> DataFrame:
    """rewards (keys, reward) with the group's mean and deviation and each one's advantage; none without a spread."""
    w = Window.partitionBy(*keys)
    made = rewards.withColumns({"reward_mean": F.avg("reward").over(w), "reward_std": F.stddev_pop("reward").over(w)})
    return made.withColumn("advantage", F.when(F.col("reward_std") >= 1e-6, (F.col("reward") - F.col("reward_mean")) / F.greatest(F.col("reward_std"), F.lit(least_std))))


def sample_signals(rows: DataFrame, keys: tuple[str, ...] = ("run_id", "doc_id")) -> DataFrame:
    """Absent fields and mean box area of each answer: what reward hacking moves."""
    b = F.col("pred_bbox")
    return rows.groupBy(*[k for k in keys if k in rows.columns]).agg(
        F.count_if(~F.col("pred_present")).alias("null_fields"), F.coalesce(F.avg(F.when(b.isNotNull() & (F.size(b) == 4), (b[2] - b[0]) * (b[3] - b[1]))), F.lit(0.0)).alias("mean_box_area"))


def rolling(history: DataFrame, column: str, width: int = 10, order: str = "step", keys: tuple[str, ...] = ()) -> DataFrame:
    """history with the mean of the last ``width`` steps, fewer at the start."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    return history.withColumn(f"{column}_rolling", F.avg(column).over(w))


def first_and_last(history: DataFrame, columns: tuple[str, ...], window: int = 10, order: str = "step", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, metric, first, last): means over the first and the last steps that have a reward; the two may overlap."""
    some = history.where(F.col("reward_mean").isNotNull()) if "reward_mean" in history.columns else history
    up, down = (Window.partitionBy(*keys).orderBy(o) for o in (F.col(order).asc(), F.col(order).desc()))
    marked = some.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down)})
    marked = marked.where((F.col("_a") <= window) | (F.col("_z") <= window)).unpivot([*keys, "_a", "_z"], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value")
    return marked.groupBy(*keys, "metric").agg(F.avg(F.when(F.col("_a") <= window, F.col("value"))).alias("first"), F.avg(F.when(F.col("_z") <= window, F.col("value"))).alias("last"))


def kl_k3(policy: Column, reference: Column) -> Column:
    """The k3 estimate of the divergence from log-probabilities: exp(d) - d - 1 with d = reference - policy; never negative."""
    d = reference - policy
    return F.exp(d) - d - 1


def loss_averages(history: DataFrame, keys: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Mean training loss per epoch and the validation loss at its end."""
    return history.groupBy(*keys).agg(F.avg("train_loss").alias("train_loss"), F.max("val_loss").alias("val_loss"), F.max("update").alias("updates"))


def running_loss(history: DataFrame, keys: tuple[str, ...] = ("epoch",), order: str = "update") -> DataFrame:
    """history with the mean training loss of its epoch so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("train_loss_mean", F.avg("train_loss").over(w))


def parameter_counts(weights: DataFrame) -> DataFrame:
    """One row over (name, shape, trainable): all parameters, those that training moves, and their share."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    made = weights.agg(F.sum(size).alias("parameters"), F.sum(F.when(F.col("trainable"), size).otherwise(0)).alias("trainable"))
    return made.withColumn("share", F.col("trainable") / F.nullif(F.col("parameters"), F.lit(0)))


def write_history(history: DataFrame, path: str) -> None:
    """A training run's steps as JSON Lines, in the order in which they are appended to the folder."""
    history.write.mode("append").json(path)
