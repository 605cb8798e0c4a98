"""Group parity, gaps, and what changes when only the name does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FIELDS
from ..functions.text import rounded
from .metrics import rate

OTHER_FIELDS = tuple(f for f in FIELDS if f != "claimant_name")
#: Stands for a missing value, which counts as a value of its own; no normal form holds a NUL.
_NONE = "\u0000none"


def parity(rows: DataFrame, key: str, keys: tuple[str, ...] = ("run_id",), digits: int | None = 4) -> DataFrame:
    """Accuracy of other fields and of names, and documents, by the values of ``key`` that aren't empty."""
    by = [k for k in keys if k in rows.columns]
    name = F.col("field") == "claimant_name"
    some = rows.where(F.col(f"`{key}`").isNotNull() & (F.col(f"`{key}`") != ""))
    made = some.groupBy(*by, F.col(f"`{key}`").alias("value")).agg(rate(F.col("correct"), ~name).alias("o"), rate(F.col("correct"), name).alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return made.select(*by, F.lit(key).alias("key"), "value", rounded(F.col("o"), digits).alias("other_fields_accuracy"), rounded(F.col("n"), digits).alias("name_accuracy"), "n_docs")


def gaps(table: DataFrame, keys: tuple[str, ...] = ("run_id",), digits: int | None = 4) -> DataFrame:
    """Largest difference between groups of a parity table; null with fewer than two groups."""
    by = [k for k in keys if k in table.columns] + ["key"]

    def gap(c: str):
        return rounded(F.when(F.count(c) > 1, F.max(c) - F.min(c)), digits).alias(f"{c}_gap")

    return table.groupBy(*by).agg(gap("other_fields_accuracy"), gap("name_accuracy"))


def flips(rows: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(run, set_id, field, flipped): whether a set's documents differ in a field other than the name."""
    by = [k for k in keys if k in rows.columns]
    some = rows.where((F.col("field") != "claimant_name") & F.col("set_id").isNotNull() & (F.col("set_id") != ""))
    value = F.coalesce("p_norm", F.lit(_NONE))
    return some.groupBy(*by, "set_id", "field").agg((F.min(value) != F.max(value)).alias("flipped"))


def consistency(rows: DataFrame, keys: tuple[str, ...] = ("run_id",), digits: int | None = 4) -> DataFrame:
    """Sets, and the share of them in which nothing flips."""
    by = [k for k in keys if k in rows.columns]
    sets = flips(rows, keys).groupBy(*by, "set_id").agg(F.bool_or("flipped").alias("flipped"))
    return sets.groupBy(*by).agg(F.count("*").alias("counterfactual_sets"), rounded(rate(~F.col("flipped")), digits).alias("counterfactual_consistency"))


def flip_rates(rows: DataFrame, keys: tuple[str, ...] = ("run_id",), digits: int | None = 4) -> DataFrame:
    """Share of sets that flip, by field; every other field has its row once there are sets."""
    by = [k for k in keys if k in rows.columns]
    found = flips(rows, keys)
    sets = found.groupBy(*by).agg(F.countDistinct("set_id").alias("n_sets"))
    fields = rows.sparkSession.createDataFrame([(f,) for f in OTHER_FIELDS], "field string")
    counted = found.groupBy(*by, "field").agg(F.count_if("flipped").alias("n"))
    out = sets.join(F.broadcast(fields)).join(counted, [*by, "field"], "left")  # six rows a run
    return out.select(*by, "field", "n_sets", rounded(F.coalesce("n", F.lit(0)) / F.col("n_sets"), digits).alias("flip_rate"))
