"""Error analysis: where errors gather."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded


def concentration(rows: DataFrame, column: str) -> DataFrame:
    """(value, fields, errors, share_of_fields, share_of_errors, lift, accuracy) by a column's values; nulls drop out.

    Order by lift, falling, to see slices with more than their share of errors.
    """
    wrong = F.count_if(~F.col("correct"))
    made = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("fields"), wrong.alias("errors"))
    totals = rows.agg(F.count("*").alias("all_fields"), wrong.alias("all_errors"))
    out = made.crossJoin(F.broadcast(totals))  # one row
    of_fields, of_errors = F.col("fields") / F.col("all_fields"), F.col("errors") / F.greatest(F.lit(1), F.col("all_errors"))
    return out.select("value", "fields", "errors", of_fields.alias("share_of_fields"), of_errors.alias("share_of_errors"), rounded(of_errors / of_fields, 2).alias("lift"), (1 - F.col("errors") / F.col("fields")).alias("accuracy"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both columns with margins named All."""
    made = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return made.select(F.when(F.col("_a") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "All").otherwise(F.col(b)).alias(b), "n")


def error_shares(rows: DataFrame) -> DataFrame:
    """(error_type, n, share) of wrong rows."""
    counts = rows.where(~F.col("correct")).groupBy("error_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # at most eleven rows


def field_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def histogram(rows: DataFrame, column: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n) over equal bins, the last one closed; values outside count for none."""
    some = rows.where(F.col(column).between(low, high))
    at = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return some.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def failures(rows: DataFrame, n: int, error_type: str | None = None, field: str | None = None, seed: int = 0) -> DataFrame:
    """n wrong, readable rows, the same ones for a seed: those of the smallest digests of their key."""
    out = rows.where(~F.col("correct") & (F.col("error_type") != "unparseable"))
    if error_type:
        out = out.where(F.col("error_type") == error_type)
    if field:
        out = out.where(F.col("field") == field)
    return out.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "doc_id", "field"), 256), "doc_id", "field").limit(n)


def right_values(rows: DataFrame, least_iou: float | None = None, most_iou: float | None = None) -> DataFrame:
    """Rows with a right value that the page has, within bounds of their citation's overlap."""
    out = rows.where(F.col("correct") & F.col("gold_present"))
    if least_iou is not None:
        out = out.where(F.col("iou") >= least_iou)
    return out if most_iou is None else out.where(F.col("iou") < most_iou)


def findings(rows: DataFrame, columns: tuple[str, ...], least_lift: float = 1.3) -> list[str]:
    """Sentences on the weakest field, the commonest error and slices with far more than their share of errors."""
    weakest = field_accuracy(rows).agg(F.min_by(F.struct("field", "accuracy"), F.struct("accuracy", "field")).alias("w")).first()
    out = []
    if weakest and weakest.w:
        out.append(f"Weakest field: {weakest.w.field} ({weakest.w.accuracy * 100:.1f}% correct).")
    top = error_shares(rows).orderBy(F.desc("n"), "error_type").first()
    if top:
        out.append(f"Most common error: {top.error_type} ({top.n} fields, {top.share * 100:.0f}% of errors).")
    for c in columns:
        row = concentration(rows, c).orderBy(F.desc("lift"), "value").first()
        if row and row.lift is not None and row.lift >= least_lift:
            out.append(f"Errors concentrate in {c} = {row.value}: {row.lift:.2f} times their share ({row.errors} errors in {row.fields} fields).")
    return out
