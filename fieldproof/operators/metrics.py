"""Run metrics over scored rows: every table is one aggregate, and rates are rounded last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FIELDS
from ..functions.text import rounded

SLICES = ("doc_type", "quality", "handwritten", "line_of_business")


def rate(flag: Column, where: Column | None = None) -> Column:
    """Mean of a flag or number over the rows where the condition holds; null over none."""
    value = flag.cast("double")
    return F.avg(value if where is None else F.when(where, value))


def as_text(value: Column) -> Column:
    """A slice key as text: True, False and None as such."""
    text = value.cast("string")
    return F.when(value.isNull(), "None").when(text == "true", "True").when(text == "false", "False").otherwise(text)


def field_summary(rows: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The rates over field rows, per run."""
    by = [k for k in keys if k in rows.columns]
    present, given = F.col("gold_present"), F.col("pred_present")
    return rows.groupBy(*by).agg(
        rate(F.col("correct")).alias("field_accuracy"),
        rate(F.col("correct") & F.col("citation_ok"), present).alias("grounded_accuracy"),
        rate(F.col("evidence_supported"), given).alias("evidence_supported_rate"),
        rate(given, ~present).alias("hallucination_rate"),
        rate(~given, present).alias("miss_rate"))


def document_summary(documents: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    by = [k for k in keys if k in documents.columns]
    return documents.groupBy(*by).agg(
        F.count("*").alias("n_docs"), rate(F.col("json_valid")).alias("json_valid_rate"), rate(F.col("schema_valid")).alias("schema_valid_rate"),
        rate(F.col("all_correct")).alias("doc_exact_match"), rate(F.col("reward")).alias("mean_reward"))


def summary(rows: DataFrame, documents: DataFrame, keys: tuple[str, ...] = ("run_id",), digits: int | None = 4) -> DataFrame:
    """All headline numbers of each run."""
    by = [k for k in keys if k in rows.columns]
    docs, fields = document_summary(documents, keys), field_summary(rows, keys)
    out = docs.join(fields, by) if by else docs.crossJoin(fields)  # one row each
    counts = [c for c in out.columns if c in by or c == "n_docs"]
    return out.select(*counts, *[rounded(F.col(c), digits).alias(c) for c in out.columns if c not in counts])


def per_field(rows: DataFrame, keys: tuple[str, ...] = ("run_id",), digits: int | None = 4) -> DataFrame:
    """Accuracy by field; every field has its row."""
    by = [k for k in keys if k in rows.columns]
    spark = rows.sparkSession
    dimension = spark.createDataFrame([(i, f) for i, f in enumerate(FIELDS)], "field_pos int, field string")
    if by:
        dimension = rows.select(*by).distinct().join(F.broadcast(dimension))  # seven rows
    made = rows.groupBy(*by, "field").agg(
        rate(F.col("correct")).alias("accuracy"), rate(F.col("correct") & F.col("citation_ok"), F.col("gold_present")).alias("grounded_accuracy"), F.count_if("gold_present").alias("n_present"))
    out = dimension.join(made, [*by, "field"], "left")
    return out.select(*by, "field_pos", "field", rounded(F.col("accuracy"), digits).alias("accuracy"), rounded(F.col("grounded_accuracy"), digits).alias("grounded_accuracy"), F.coalesce("n_present", F.lit(0)).alias("n_present"))


def slices(rows: DataFrame, keys: tuple[str, ...] = ("run_id",), by_columns: tuple[str, ...] = SLICES, digits: int | None = 4) -> DataFrame:
    """Accuracy by each slice column, all in one pass: (run, slice, value, n_fields, field_accuracy)."""
    by = [k for k in keys if k in rows.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), as_text(F.col(c)).alias("value")) for c in by_columns])).alias("s")
    flat = rows.select(*by, "correct", pairs).select(*by, "correct", "s.*")
    return flat.groupBy(*by, "slice", "value").agg(F.count("*").alias("n_fields"), rate(F.col("correct")).alias("r")).select(*by, "slice", "value", "n_fields", rounded(F.col("r"), digits).alias("field_accuracy"))


def error_types(rows: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Counts of wrong rows by error type, with the order of first appearance for ties (order by count desc, first)."""
    by = [k for k in keys if k in rows.columns]
    seen = F.struct(*[c for c in ("seq", "doc_id", "field_pos") if c in rows.columns])
    return rows.where(~F.col("correct")).groupBy(*by, "error_type").agg(F.count("*").alias("n"), F.min(seen).alias("first"))


def nearest_rank(values: DataFrame, value: str, keys: tuple[str, ...] = (), shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The value at index min(n - 1, floor(share * n)) of each group's sorted values; nulls don't count.

    Values are counted before they are ranked, so a group's repeated values travel once; the rank is a running sum.
    """
    some = values.where(F.col(value).isNotNull())
    counted = some.groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    total = F.sum("c").over(Window.partitionBy(*keys))
    placed = counted.withColumns({"upto": F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": total})
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(s))), F.col(value))).alias(f"p{int(round(s * 100))}") for s in shares]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
