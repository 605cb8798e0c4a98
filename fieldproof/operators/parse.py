"""From raw model text to fields: which part is JSON, is it valid, and what can be kept of it.

The whole-text extraction is a column expression; reading JSON is an Arrow UDF, because duplicate keys, NaN, number texts
and salvage of single fields follow Python's reader.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIELDS
from ..schemas import PARSED


def json_text(raw: Column) -> Column:
    """The JSON part of a text: of the first fenced block if there is one, from the first bracket to its last closer."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    body = F.when(raw.rlike(fence), F.regexp_extract(raw, fence, 1)).otherwise(raw)
    # up to the first bracket, then from it to the last closer of its kind
    found = F.regexp_extract(body, r"(?s)^[^{\[]*+(\{.*\}|\[.*\])", 1)
    return F.nullif(found, F.lit(""))


def _page(v: Any) -> int | None:
    """A page number that a column of 32 bits can hold; anything else is none."""
    if isinstance(v, float):
        v = int(v) if v.is_integer() else None
    elif isinstance(v, str):
        try:
            v = int(v.strip())
        except ValueError:
            v = None
    return int(v) if isinstance(v, int) and -(2**31) <= v < 2**31 else None


def _text(s: str) -> str:
    """The text with a question mark for each half of a surrogate pair that stands alone, which no column can hold."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace").replace("\ufffd", "?") if any("\ud800" <= c <= "\udfff" for c in s) else s


def _box(v: Any) -> list[float] | None:
    """Four numbers as corners in rising order; anything else is no box."""
    try:
        x0, y0, x1, y1 = (float(x) for x in v)
    except (TypeError, ValueError, OverflowError):
        return None
    return [round(x, 1) for x in (min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))]


def read_field(v: Any) -> tuple[dict | None, bool]:
    """(field or None, whether it fits the schema) of one member of the object."""
    if v is None:
        return None, True
    if isinstance(v, dict):
        if v.get("value") is None or v.get("value") == "":
            return None, True
        bare = {"value": _text(str(v["value"])), "evidence_text": None, "page": 1, "bbox": None}
        evidence, page = v.get("evidence_text"), _page(v.get("page", 1))
        box = None if v.get("bbox") is None else _box(v["bbox"])
        if page is None or not (evidence is None or isinstance(evidence, str)) or (box is None and v.get("bbox") is not None):
            return bare, False
        return {"value": bare["value"], "evidence_text": evidence and _text(evidence), "page": page, "bbox": box}, True
    if isinstance(v, (str, int, float)):
        return {"value": _text(str(v)), "evidence_text": None, "page": 1, "bbox": None}, False
    return None, False


def read_object(text: str | None) -> dict:
    """What a JSON text holds: flags, the reason of a failure, and one entry per field in order."""
    out: dict[str, Any] = {"json_valid": False, "schema_valid": False, "error": None, "fields": [None] * len(FIELDS)}
    if text is None:
        return out | {"error": "no_json_found"}
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return out | {"error": "invalid_json"}
    in_list = isinstance(found, list) and len(found) == 1 and isinstance(found[0], dict)
    if in_list:
        found = found[0]
    if not isinstance(found, dict):
        return out | {"error": "json_not_an_object"}
    read = [read_field(found.get(name)) for name in FIELDS]
    fits = all(ok for _, ok in read)
    error = None if fits and not in_list else "wrapped_in_list" if fits and in_list else "schema_error"
    return {"json_valid": True, "schema_valid": error is None, "error": error, "fields": [f for f, _ in read]}


#: PARSED as Arrow has it.
_FIELD = pa.struct([("value", pa.string()), ("evidence_text", pa.string()), ("page", pa.int32()), ("bbox", pa.list_(pa.float64()))])
_PARSED = pa.struct([("json_valid", pa.bool_()), ("schema_valid", pa.bool_()), ("error", pa.string()), ("fields", pa.list_(_FIELD))])


def _read(texts: pa.Array) -> pa.Array:
    return pa.array([read_object(t) for t in texts.to_pylist()], _PARSED)


def parsed(raw: Column) -> Column:
    """PARSED of a raw text."""
    return F.arrow_udf(_read, PARSED).asNondeterministic()(json_text(raw))


def with_parsed(outputs: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    return outputs.withColumn("parsed", parsed(F.col(raw_col)))


def rescaled(outputs: DataFrame, sx: Column, sy: Column, raw_col: str = "raw_output") -> DataFrame:
    """Boxes in the raw text scaled; texts that can't be read, and boxes that aren't four numbers, stay as they are."""

    def scale(texts: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(text: str | None, x: float, y: float) -> str | None:
            try:
                found = json.loads(text)
                members = found.values() if isinstance(found, dict) else ()
            except (ValueError, TypeError, RecursionError):
                return text
            touched = False
            for v in members:
                if isinstance(v, dict) and isinstance(v.get("bbox"), list) and len(v["bbox"]) == 4 and all(isinstance(b, (int, float)) for b in v["bbox"]):
                    v["bbox"] = [round(b * (x if i % 2 == 0 else y), 1) for i, b in enumerate(v["bbox"])]
                    touched = True
            return json.dumps(found, ensure_ascii=False) if touched else text

        return pd.Series([one(t, x, y) for t, x, y in zip(texts, xs, ys)])

    return outputs.withColumn("raw_text_before_rescale", F.col(raw_col)).withColumn(raw_col, F.pandas_udf(scale, "string")(F.col(raw_col), sx, sy))
