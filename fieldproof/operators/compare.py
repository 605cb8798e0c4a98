"""Runs side by side, the registry and its release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FIRST_EVALUATOR_VERSION, GATE, HEADLINE, REGISTRY_METRICS


def long_metrics(runs: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, metric, value), a row per run and metric."""
    return runs.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def against_base(values: DataFrame, run_col: str = "run_id", order_col: str = "run_order") -> DataFrame:
    """values (run, order, metric, value) with the first run's value, the change, and whether it is for the better.

    Changes of at most 1e-9 are none. ``higher_is_better`` is taken from the headline metrics; others rise for the better.
    """
    base = values.groupBy("metric").agg(F.min_by("value", order_col).alias("base"), F.min(order_col).alias("first"))
    lower = [k for k, _, higher in HEADLINE if not higher]
    changed = (F.col(order_col) != F.col("first")) & F.col("value").isNotNull() & F.col("base").isNotNull() & (F.abs(F.col("value") - F.col("base")) > 1e-9)
    return values.join(F.broadcast(base), "metric").select(  # a row per metric
        run_col, order_col, "metric", "value", "base", F.when(changed, F.col("value") - F.col("base")).alias("delta"),
        F.when(changed, (F.col("value") > F.col("base")) == ~F.col("metric").isin(lower)).alias("better"))


def error_type_table(counts: DataFrame, runs: list[str], run_col: str = "run_id") -> DataFrame:
    """(error_type, a column per run): counts of all types of any run, 0 where a run lacks one."""
    return counts.groupBy("error_type").pivot(run_col, runs).agg(F.sum("n")).na.fill(0)


def mixed_evaluators(runs: DataFrame) -> DataFrame:
    """One row: the evaluator versions, and whether there is more than one."""
    version = F.coalesce("evaluator_version", F.lit(FIRST_EVALUATOR_VERSION))
    return runs.agg(F.sort_array(F.collect_set(version)).alias("versions")).withColumn("mixed", F.size("versions") > 1)


def best_per_metric(values: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """values (model, metric, value) with best: whether no other is better; ties are all best."""
    w = Window.partitionBy("metric")
    top = F.when(F.col("metric").isin(lower_is_better), F.min("value").over(w)).otherwise(F.max("value").over(w))
    return values.withColumn("best", F.col("value") == top)


def results_table(evaluations: DataFrame, splits: list[str], metrics: list[str]) -> DataFrame:
    """A row per model, a column per split and metric."""
    return evaluations.groupBy("model").pivot("split", splits).agg(*[F.first(m).alias(m) for m in metrics])


def model_of_run(run_id):
    """The model of a run named <model>_v2_greedy_<split>; null for other names and quick runs."""
    mark = "_v2_greedy_"
    return F.when(run_id.contains(mark) & ~run_id.startswith("quick_"), F.substring_index(run_id, mark, 1))


def registry(cards: DataFrame, runs: DataFrame, base_model: str) -> tuple[DataFrame, DataFrame]:
    """(models, evaluations) from training cards and run metrics.

    Models have their lineage (the direct parent, then the adapter); a run's model without a card was trained by
    unknown means. Of several runs of a model and split the last by path counts.
    """
    card = cards.select(
        F.coalesce("adapter_name", F.col("_dir") if "_dir" in cards.columns else F.lit(None)).alias("model"), F.coalesce("base_model", F.lit(base_model)).alias("base_model"), "base_revision",
        F.array_compact(F.array("parent_adapter", F.struct(F.coalesce("adapter_name", F.col("_dir") if "_dir" in cards.columns else F.lit(None)).alias("name"), F.col("adapter_sha256").alias("sha256")))).alias("adapters"),
        F.coalesce("mode", F.lit("sft")).alias("trained_by"), F.coalesce("training.quick_test", "quick_test").alias("quick_test"), F.lit(1).alias("_card"))
    order = F.col("_path") if "_path" in runs.columns else F.col("run_id")
    last = Window.partitionBy("model", "split").orderBy(F.desc("_order"))
    named = runs.withColumn("model", model_of_run(F.col("run_id"))).where("model is not null").withColumn("_order", order)
    evaluations = named.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(
        "model", "split", "run_id", F.coalesce("evaluator_version", F.lit(FIRST_EVALUATOR_VERSION)).alias("evaluator_version"), *REGISTRY_METRICS,
        F.when(F.col("counterfactual_sets") > 0, F.col("counterfactual_consistency")).alias("counterfactual_consistency"))
    spark = cards.sparkSession
    names = evaluations.select("model").union(spark.createDataFrame([("baseline",)], "model string")).distinct()
    models = names.join(card, "model", "full_outer").select(
        "model", F.coalesce("base_model", F.lit(base_model)).alias("base_model"), "base_revision", F.coalesce("adapters", F.slice("adapters", 1, 0), F.array().cast(card.schema["adapters"].dataType)).alias("adapters"),
        F.when(F.col("_card") == 1, F.col("trained_by")).when(F.col("model") != "baseline", F.lit("unknown")).alias("trained_by"), "quick_test")
    return models, evaluations


def gate_rows(evaluations: DataFrame, models: DataFrame, candidate: str, production: str | None) -> DataFrame:
    """(pos, split, metric, candidate, production, result, passed): every check of the release gate.

    A null candidate value fails where production has one; without a production value a check passes.
    """
    spark = evaluations.sparkSession
    spec = spark.createDataFrame([(i, *row) for i, row in enumerate(GATE)], "pos int, split string, metric string, higher boolean, slack double")
    metrics = sorted({m for _, m, _, _ in GATE})
    long = long_metrics(evaluations, metrics, ("model", "split", "evaluator_version"))
    cand = long.where(F.col("model") == candidate).select("split", "metric", F.col("value").alias("candidate"), F.col("evaluator_version").alias("cv"), F.lit(1).alias("found"))
    prod = long.where(F.col("model") == (production if production is not None else "")).where(F.lit(production is not None)).select("split", "metric", F.col("value").alias("production"), F.col("evaluator_version").alias("pv"))
    joined = spec.join(cand, ["split", "metric"], "left").join(prod, ["split", "metric"], "left")  # six rows
    c, p = F.col("candidate"), F.col("production")
    ok = F.when(p.isNull(), True).otherwise(F.coalesce(F.when(F.col("higher"), c >= p - F.col("slack")).otherwise(c <= p + F.col("slack")), F.lit(False)))
    result = F.when(p.isNull(), "pass (no production yet)").when(ok, "pass").otherwise("FAIL")
    checks = joined.where("found = 1").select("pos", "split", "metric", "candidate", "production", result.alias("result"), ok.alias("passed"))
    missing = joined.where("found is null").groupBy("split").agg(F.min("pos").alias("pos")).select("pos", "split", F.lit("(missing)").alias("metric"), F.lit(None).cast("double").alias("candidate"), F.lit(None).cast("double").alias("production"), F.lit("FAIL: candidate not evaluated on this split").alias("result"), F.lit(False).alias("passed"))
    mixed = joined.where("found = 1 and pv is not null and cv != pv").groupBy("split").agg((F.min("pos") - 1).alias("pos")).select("pos", "split", F.lit("(evaluator)").alias("metric"), F.lit(None).cast("double").alias("candidate"), F.lit(None).cast("double").alias("production"), F.lit("FAIL: scored with different evaluator versions").alias("result"), F.lit(False).alias("passed"))
    quick = models.where((F.col("model") == candidate) & F.coalesce("quick_test", F.lit(False))).select(F.lit(len(GATE)).alias("pos"), F.lit("-").alias("split"), F.lit("(training)").alias("metric"), F.lit(None).cast("double").alias("candidate"), F.lit(None).cast("double").alias("production"), F.lit("FAIL: adapter came from a quick test run").alias("result"), F.lit(False).alias("passed"))
    return checks.unionByName(missing).unionByName(mixed).unionByName(quick)


def verdict(rows: DataFrame) -> DataFrame:
    return rows.agg(F.bool_and("passed").alias("ok"), F.count_if(~F.col("passed")).alias("failed"))
