"""One row per (document, field): right or wrong, how it went wrong, and whether the cited box supports it.

A document's texts are normalised in one call; all rules after that are column expressions over the row's own layout
array, so scoring has no shuffle beyond the join of outputs and labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_COSTS, FIELDS, GROUNDING_SHARE, IOU_THRESHOLD, NEAR_MISS, REWARD_WEIGHTS, SCHEMA_NUDGE,
)
from ..functions import geometry as G
from ..functions import text as T
from .parse import with_parsed


def gold_array(labels: DataFrame) -> DataFrame:
    """labels with gold: one struct per field in order, null where the page lacks the field."""
    return labels.withColumn("gold", F.array(*[F.col(f"fields.{name}") for name in FIELDS]))


def long_rows(outputs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """outputs (keys, doc_id, raw_output) joined to labels, a row per field with all normal forms; layout normalised."""
    # Python's evaluation loses what Spark knows of a table's partitions, so all joins by doc_id come before it
    return long_rows_of(outputs.join(gold_array(labels).select("doc_id", "gold", F.coalesce("layout", F.array().cast(labels.schema["layout"].dataType)).alias("layout")), "doc_id"), keys)


def long_rows_of(answered: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """:func:`long_rows` of rows (keys, doc_id, raw_output, gold, layout) that hold an output and its label already."""
    keep = [k for k in keys if k in answered.columns]
    extra = [c for c in ("latency_ms",) if c in answered.columns]
    joined = with_parsed(answered)
    n = F.size("layout")
    texts = F.concat(F.transform("layout", lambda s: s["text"]), F.transform("parsed.fields", lambda p: p["value"]), F.transform("gold", lambda g: g["value"]))
    made = joined.withColumn("forms", T.forms_of(texts))
    made = made.withColumn("segments", F.arrays_zip("layout", F.slice("forms", F.lit(1), n).alias("forms")))
    names = F.array(*map(F.lit, FIELDS))
    rows = made.select(
        *keep, "doc_id", *extra, F.col("parsed.json_valid").alias("json_valid"), F.col("parsed.schema_valid").alias("schema_valid"), F.col("parsed.error").alias("parse_error"),
        "segments", n.alias("n"), F.posexplode(F.arrays_zip(
            names.alias("field"), F.col("parsed.fields").alias("pred"), F.col("gold").alias("gold"),
            F.slice("forms", n + 1, F.lit(len(FIELDS))).alias("pf"), F.slice("forms", n + 1 + len(FIELDS), F.lit(len(FIELDS))).alias("gf"))).alias("field_pos", "x"))
    return rows.select(*keep, "doc_id", *extra, "json_valid", "schema_valid", "parse_error", "field_pos", "x.*", "segments")


def _own_form(segment: Column) -> Column:
    return T.form_for(segment["layout"]["field"], segment["forms"])


def score_fields(rows: DataFrame) -> DataFrame:
    """The scored columns for rows of :func:`long_rows`."""
    field, p, g, segments = F.col("field"), F.col("p_norm"), F.col("g_norm"), F.col("segments")
    rows = rows.withColumns({"p_norm": T.form_for(field, F.col("pf")), "g_norm": T.form_for(field, F.col("gf"))})

    def kinds(segment: Column) -> Column:
        return T.form_for(field, segment["forms"])

    def role(segment: Column) -> Column:
        return segment["layout"]["role"]

    copied = F.exists(segments, lambda s: role(s).isin("distractor", "value") & ((kinds(s) == p) | (s["forms"]["text"] == p)))
    confused = F.exists(segments, lambda s: (role(s) == "distractor") & (s["layout"]["field"] == field) & (kinds(s) == p))
    swapped = F.exists(segments, lambda s: (role(s) == "value") & s["layout"]["field"].isNotNull() & (s["layout"]["field"] != field) & ((_own_form(s) == p) | (s["forms"]["text"] == p)))

    def bare(norm: Column, made: Column) -> Column:
        return F.when(norm == made["text"], made["plain"]).otherwise(norm)

    wrong = (
        F.when(F.coalesce(confused, F.lit(False)), "distractor_confusion")
        .when(F.coalesce(swapped, F.lit(False)), "field_swap")
        .when(bare(p, F.col("pf")) == bare(g, F.col("gf")), "diacritics")
        .when(T.similarity(p, g) >= NEAR_MISS, "near_miss")
        .otherwise("wrong_value"))
    kind = (
        F.when(~F.col("json_valid"), "unparseable")
        .when(g.isNull() & p.isNull(), "correct_null")
        .when(g.isNull(), F.when(F.coalesce(copied, F.lit(False)), "distractor_for_absent").otherwise("hallucinated"))
        .when(p.isNull(), "missed")
        .when(p == g, "correct")
        .otherwise(wrong))
    box = F.col("pred.bbox")
    overlap = F.when(p.isNotNull() & F.col("gold").isNotNull(), T.rounded(G.iou(box, F.col("gold.bbox")), 3)).otherwise(0.0)

    def holds(inside: Column) -> Column:
        # folding a joined text is joining the folded ones, but for the marks at its end
        cited = F.regexp_replace(F.array_join(F.transform(inside, lambda s: s["forms"]["whole"]), " "), T.END_MARKS, "")
        return (F.size(inside) > 0) & (F.coalesce(F.exists(inside, lambda s: kinds(s) == p), F.lit(False)) | ((F.length(p) > 3) & cited.contains(p)))

    supported = F.when(p.isNotNull() & ~G.missing(box), T.bound(F.filter(segments, lambda s: G.covered(s["layout"]["bbox"], box) >= 0.5), holds))
    out = rows.withColumns({
        "gold_value": F.col("gold.value"), "pred_value": F.col("pred.value"), "gold_present": g.isNotNull(), "pred_present": p.isNotNull(),
        "error_type": kind, "iou": overlap, "evidence_supported": F.coalesce(supported, F.lit(False)), "pred_bbox": box, "gold_bbox": F.col("gold.bbox")})
    out = out.withColumn("correct", F.col("error_type").isin("correct", "correct_null"))
    # a citation counts as it stood before the whole output was found unreadable: then nothing was predicted anyway
    out = out.withColumn("citation_ok", F.col("correct") & (F.col("iou") >= IOU_THRESHOLD) & p.isNotNull())
    return out.drop("pred", "gold", "pf", "gf", "segments")


def score(outputs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return score_fields(long_rows(outputs, labels, keys))


META = ("doc_type", "line_of_business", "quality", "handwritten", "skew_deg", "group", "gender", "set_id")


def score_with_meta(outputs: DataFrame, labels: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The rows of ``with_meta(score(outputs, labels, keys), manifest)``, joined a document and not a field at a time.

    Where labels and manifest are bucketed by doc_id, only the outputs are shuffled, once.
    """
    narrow = outputs.drop(*[c for c in META if c in outputs.columns and c not in keys])
    return score(with_meta(narrow, manifest), labels, (*keys, *(c for c in META if c in manifest.columns)))


def with_meta(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """rows left-joined to the manifest's columns; of repeated manifest ids the last row counts."""
    have = [c for c in META if c in manifest.columns]
    order = F.col("seq") if "seq" in manifest.columns else F.lit(0)
    last = manifest.groupBy("doc_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in have]), order).alias("m")).select("doc_id", "m.*")
    return rows.join(last, "doc_id", "left")


def grounding(correct: Column, supported: Column, overlap: Column) -> Column:
    """Credit for the citation of a right value, 0 to 1."""
    return F.when(correct, 0.5 * supported.cast("double") + 0.5 * F.least(F.lit(1.0), overlap / IOU_THRESHOLD)).otherwise(0.0)


def document_scores(rows: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """A row per document: accuracy, grounding and reward; rates rounded as reports show them."""
    by = [k for k in keys if k in rows.columns] + ["doc_id"]
    extra = [F.first("latency_ms").alias("latency_ms")] if "latency_ms" in rows.columns else []
    present = F.col("gold_present")
    made = rows.groupBy(*by).agg(
        F.first("json_valid").alias("json_valid"), F.first("schema_valid").alias("schema_valid"), F.first("parse_error").alias("parse_error"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.when(present, (F.col("correct") & F.col("citation_ok")).cast("double"))).alias("grounded"),
        F.avg(F.when(present, grounding(F.col("correct"), F.col("evidence_supported"), F.col("iou")))).alias("grounding"),
        F.bool_and("correct").alias("all_correct"), *extra)
    valid = F.col("json_valid")
    parts = {
        "format": F.when(valid, F.when(F.col("schema_valid"), 1.0).otherwise(0.5)).otherwise(0.0),
        "accuracy": F.when(valid, F.col("accuracy")).otherwise(0.0),
        "grounding": F.when(valid, F.coalesce("grounding", F.lit(1.0))).otherwise(0.0),
    }
    reward = sum((F.lit(REWARD_WEIGHTS[k]) * v for k, v in parts.items()), F.lit(0.0))
    return made.select(
        *by, "json_valid", "schema_valid", "parse_error", T.rounded(F.col("accuracy")).alias("field_accuracy"),
        T.rounded(F.coalesce("grounded", F.lit(1.0))).alias("grounded_accuracy"), "all_correct", T.rounded(reward).alias("reward"),
        F.struct(*[T.rounded(v).alias(k) for k, v in parts.items()]).alias("reward_components"), *[c for c in ("latency_ms",) if c in rows.columns])


def outcome(error_type: Column) -> Column:
    """The cost class of an error type."""
    return (
        F.when(error_type.isin("correct", "correct_null"), error_type).when(error_type == "missed", "miss")
        .when(error_type.isin("hallucinated", "distractor_for_absent"), "hallucination").when(error_type == "unparseable", "invalid").otherwise("wrong"))


def costed_rewards(rows: DataFrame, keys: tuple[str, ...] = ("run_id",), costs: dict[str, float] | None = None) -> DataFrame:
    """A row per document: reward in [-1, 1] by the cost of each outcome, and the outcomes' counts."""
    price = DEFAULT_COSTS | (costs or {})
    by = [k for k in keys if k in rows.columns] + ["doc_id"]
    kind = outcome(F.col("error_type"))
    credit = price["correct"] * ((1 - GROUNDING_SHARE) + GROUNDING_SHARE * grounding(F.lit(True), F.col("evidence_supported"), F.col("iou")))
    worth = F.when(kind == "correct", credit)
    for name in ("correct_null", "miss", "hallucination", "wrong"):
        worth = worth.when(kind == name, F.lit(float(price[name])))
    made = rows.withColumns({"outcome": kind, "worth": worth}).groupBy(*by).agg(
        F.first("json_valid").alias("json_valid"), F.first("schema_valid").alias("schema_valid"), (F.sum("worth") / len(FIELDS)).alias("mean"),
        *[F.count_if(F.col("outcome") == c).alias(f"n_{c}") for c in ("correct", "correct_null", "miss", "hallucination", "wrong")])
    nudged = F.col("mean") - F.when(F.col("schema_valid"), 0.0).otherwise(SCHEMA_NUDGE)
    counts = [F.when(F.col("json_valid"), F.col(f"n_{c}")).otherwise(0).alias(f"n_{c}") for c in ("correct", "correct_null", "miss", "hallucination", "wrong")]
    return made.select(
        *by, F.when(F.col("json_valid"), T.rounded(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), nudged)))).otherwise(F.lit(float(price["invalid"]))).alias("reward"),
        *counts, F.when(F.col("json_valid"), 0).otherwise(1).alias("n_invalid"))


