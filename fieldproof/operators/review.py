"""Reasons for a person to look at an extraction, and the bundle that replays shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIELDS, REQUIRED_FIELDS
from ..functions import geometry as G
from ..functions import text as T


def with_review(outputs: DataFrame) -> DataFrame:
    """outputs (parsed) with review_reasons and needs_review."""
    fields = F.col("parsed.fields")
    texts = F.concat(F.transform(fields, lambda f: f["value"]), F.transform(fields, lambda f: f["evidence_text"]))
    out = outputs.withColumn("_forms", T.forms_of(texts))
    reasons: list[Column] = [F.when(~F.col("parsed.schema_valid"), F.lit("output did not match the schema exactly"))]
    for i, name in enumerate(FIELDS):
        f = fields[i]
        value, evidence = (T.form_for(F.lit(name), F.col("_forms")[i + k]) for k in (0, len(FIELDS)))
        if name in REQUIRED_FIELDS:
            reasons.append(F.when(f.isNull(), F.lit(f"{name}: required field not found")))
        reasons.append(F.when(f.isNotNull() & G.missing(f["bbox"]), F.lit(f"{name}: value has no citation box")))
        stated = F.coalesce(f["evidence_text"], F.lit("")) != ""
        reasons.append(F.when(f.isNotNull() & stated & ~value.eqNullSafe(evidence), F.lit(f"{name}: value does not match its own evidence text")))
    all_reasons = F.when(~F.col("parsed.json_valid"), F.array(F.lit("model output could not be parsed"))).otherwise(F.array_compact(F.array(*reasons)))
    return out.withColumn("review_reasons", all_reasons).withColumn("needs_review", F.size("review_reasons") > 0).drop("_forms")


def replay_bundle(labels: DataFrame, outputs: DataFrame, documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, split, bundle): for each chosen document its label and every model's output and scores, as JSON.

    chosen (doc_id, note) is a short list, so it is what the others are reduced to first.
    """
    some = F.broadcast(chosen.select("doc_id", "note"))  # a hand-written list
    reviewed = with_review(outputs.join(some, "doc_id"))
    scores = documents.join(some.select("doc_id"), "doc_id", "left_semi")
    each = reviewed.join(scores.drop("latency_ms"), ["run_id", "doc_id"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(
        "run_id", "raw_output", "review_reasons", F.struct("field_accuracy", "grounded_accuracy", "all_correct", "reward").alias("scores")))).alias("predictions"))
    out = labels.join(some, "doc_id").join(each, "doc_id")
    return out.select("doc_id", F.substring_index("doc_id", "-", 1).alias("split"), F.to_json(F.struct("doc_id", "note", "doc_type", "width", "height", F.col("fields").alias("gold"), "predictions")).alias("bundle"))


#: Label and tone of each error type.
VERDICTS = {
    "correct": ("Correct", "good"),
    "correct_null": ("Correctly absent", "good"),
    "missed": ("Missed", "bad"),
    "hallucinated": ("Hallucinated", "bad"),
    "distractor_for_absent": ("Copied another value", "bad"),
    "distractor_confusion": ("Wrong value from page", "bad"),
    "field_swap": ("Field swap", "bad"),
    "diacritics": ("Accents lost", "warn"),
    "near_miss": ("Near miss", "warn"),
    "wrong_value": ("Wrong value", "bad"),
    "unparseable": ("Unreadable output", "bad"),
}


def with_verdict(rows: DataFrame) -> DataFrame:
    """rows with label and tone of their error type (unknown types muted), and the tone of the drawn box."""
    table = rows.sparkSession.createDataFrame([(k, *v) for k, v in VERDICTS.items()], "error_type string, verdict string, tone string")
    out = rows.join(F.broadcast(table), "error_type", "left")  # eleven rows
    tone = F.coalesce("tone", F.lit("muted"))
    return out.withColumns({"verdict": F.coalesce("verdict", "error_type"), "tone": tone, "box_tone": F.when((tone == "good") & ~F.col("citation_ok"), "warn").otherwise(tone)})
