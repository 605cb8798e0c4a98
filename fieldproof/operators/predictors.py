"""Predictors: the contract, and a simulated one that plants known errors in the truth."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIELDS
from ..functions import text as T
from ..schemas import FIELD
from .scoring import gold_array

# Planted rates, replacements of digits, and invented values.
P_ERROR = {"clean": 0.03, "moderate": 0.08, "poor": 0.18}
P_HANDWRITTEN, P_INVENT, P_TOTAL_SWAP, P_DATE_SWAP, P_ACCENT, P_SHIFT, P_TRUNCATE = 0.12, 0.05, 0.15, 0.08, 0.35, 0.06, 0.03
DIGITS, SWAPPED = "0123456789", "8778966134"
INVENTED = {"incident_type": "Auto collision", "policy_number": "POL-000-0000-A", "claim_number": "CLM-2025-000001", "provider_name": "Unknown Provider"}


def predict(labels: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str = "doc_id string, raw_output string, latency_ms double") -> DataFrame:
    """Any predictor: a function over batches of labels (load the model once, before the loop)."""
    return labels.mapInPandas(model, schema)


def _typo(value: Column, *key: Column) -> Column:
    """The value with one letter or digit replaced."""
    at = (F.floor(T.uniform(*key, F.lit("at")) * F.length(value)) + 1).cast("int")
    c = F.substring(value, at, F.lit(1))
    letter = T.pick(F.array(*map(F.lit, "aeilnorstu")), *key, F.lit("letter"))
    new = F.when(c.rlike("[0-9]"), F.translate(c, DIGITS, SWAPPED)).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)
    return F.when(F.length(value) > 0, F.overlay(value, new, at, F.lit(1))).otherwise(value)


def _distractors(name: str) -> Column:
    return F.filter("layout", lambda s: (s["role"] == "distractor") & (s["field"] == name))


def simulated(labels: DataFrame, seed: int = 7, bias_group: str | None = None, bias_strength: float = 0.0) -> DataFrame:
    """(doc_id, raw_output, latency_ms) with planted errors that keys decide.

    Fields other than the name are keyed on the set, so variants of a set differ only where bias is planted.
    """
    made = gold_array(labels).withColumn("plain_name", T.forms_of(F.array("fields.claimant_name.value"))[0]["plain"])
    s = F.lit(str(seed))
    base = F.coalesce("meta.set_id", "doc_id")
    p_err = F.coalesce(*[F.when(F.col("meta.quality") == q, p) for q, p in P_ERROR.items()]) + F.when(F.col("meta.handwritten"), P_HANDWRITTEN).otherwise(0.0)
    lines = []
    for i, name in enumerate(FIELDS):
        key = (s, F.col("doc_id") if name == "claimant_name" else base, F.lit(name))
        gold = F.col("gold")[i]

        def u(what: str, key=key) -> Column:
            return T.uniform(*key, F.lit(what))

        def struct(value: Column, evidence: Column, box: Column) -> Column:
            return F.struct(value.alias("value"), evidence.alias("evidence_text"), F.lit(1).alias("page"), box.alias("bbox")).cast(FIELD)

        fake = F.lit(INVENTED.get(name, "N/A"))
        invented = F.when(u("invent") < P_INVENT, struct(fake, fake, F.array(*map(F.lit, (60.0, 60.0, 200.0, 80.0)))))
        value = gold["value"]
        if name == "claimant_name":
            # accents go, the rest stays as printed
            value = F.when(u("accent") < P_ACCENT, F.translate(value, "áéíóúñÁÉÍÓÚÑ", "aeiounAEIOUN")).otherwise(value)
        value = F.when(u("read") < p_err, _typo(value, *key)).otherwise(value)
        if name == "total_amount" and bias_group:
            hit = (F.col("meta.group") == bias_group) & (T.uniform(s, F.col("doc_id"), F.lit("bias")) < bias_strength)
            value = F.when(hit, _typo(value, s, F.col("doc_id"), F.lit("biased"))).otherwise(value)
        box = F.when(u("shift") < P_SHIFT, F.transform(gold["bbox"], lambda x, j: F.when(j % 2 == 1, x + 45.0).otherwise(x))).otherwise(gold["bbox"])
        read = F.when(u("read") >= p_err * 0.25, struct(value, gold["evidence_text"], box))
        others = _distractors(name)
        if name in ("total_amount", "date_of_loss"):
            seg = F.when(F.size(others) > 0, F.element_at(others, -1 if name == "total_amount" else 1))
            swap = (F.col("doc_type") == "invoice") & (u("swap") < P_TOTAL_SWAP) if name == "total_amount" else u("swap") < P_DATE_SWAP
            read = F.when(swap & seg.isNotNull(), struct(seg["text"], seg["text"], seg["bbox"])).otherwise(read)
        picked = F.when(gold.isNull(), invented).otherwise(read)
        lines.append(F.concat(F.lit(f' "{name}": '), F.coalesce(F.to_json(picked), F.lit("null"))))
    text = F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
    cut = F.when(T.uniform(s, base, F.lit("truncate")) < P_TRUNCATE, F.substring(text, F.lit(1), F.floor(F.length(text) * 0.6).cast("int"))).otherwise(text)
    return made.select("doc_id", cut.alias("raw_output"), (20.0 + 10.0 * T.uniform(s, F.col("doc_id"), F.lit("ms"))).alias("latency_ms"))
