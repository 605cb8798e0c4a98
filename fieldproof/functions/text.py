"""Normal forms of values.

Spark has no NFKC, NFKD or case folding, so these run as Arrow UDFs over plain Python functions; a call normalises the
distinct texts of a batch of arrays, and a worker keeps the forms of texts that come again. They are marked so that the
planner never evaluates a call twice. The UDFs are total: they never raise, as Spark may evaluate them outside a guard.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import KIND_OF_FIELD

FORMS = "struct<date: string, amount: string, id: string, text: string, plain: string, whole: string>"

# Date formats in the order in which they are tried (US before day-first).
_FORMATS = ("%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%B %d, %Y", "%b %d, %Y", "%b. %d, %Y", "%d %B %Y", "%d %b %Y", "%Y/%m/%d", "%m/%d/%y")
#: What any of the formats can read looks like this; most texts don't, and are spared the tries.
_DATE_SHAPE = re.compile(r"\d{1,4}[-/]\d{1,2}[-/]\d{2,4}|[^\W\d_]+\.? \d{1,2}, \d{4}|\d{1,2} [^\W\d_]+ \d{4}")
_SPACES = re.compile(r"\s+")
_CURRENCY = re.compile(r"\b(?:usd|cad|us|ca)\b", re.IGNORECASE)
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")


def clean(s: str) -> str:
    return _SPACES.sub(" ", s if s.isascii() else unicodedata.normalize("NFKC", s)).strip()


def folded(s: str) -> str:
    return clean(s).casefold().rstrip(".,;:")


#: What :func:`folded` takes from the end, as a pattern.
END_MARKS = "[.,;:]+$"


def iso_date(s: str) -> str | None:
    s = clean(s).rstrip(".")
    if not _DATE_SHAPE.fullmatch(s):
        return None
    for pattern in _FORMATS:
        try:
            return datetime.strptime(s, pattern).date().isoformat()
        except ValueError:
            pass
    return None


def amount(s: str) -> str | None:
    s = _CURRENCY.sub("", clean(s)).translate({ord(c): None for c in "$, "})
    return f"{float(s):.2f}" if _NUMBER.fullmatch(s) else None


def identifier(s: str) -> str:
    return "".join(c for c in clean(s) if c.isascii() and c.isalnum()).upper()


def without_accents(s: str) -> str:
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@lru_cache(100_000)
def forms(value: str | None) -> tuple[str, ...] | None:
    """All normal forms of a value, or None for a missing or blank one."""
    if value is None or not value.strip():
        return None
    text = folded(value)
    return iso_date(value) or text, amount(value) or text, identifier(value), text, without_accents(text), clean(value).casefold()


def normalized(field: str, value: str | None) -> str | None:
    made = forms(value)
    return made and made[("date", "amount", "id", "text").index(KIND_OF_FIELD.get(field, "text"))]


def _forms(values: pa.Array) -> pa.Array:
    """The forms of a batch of arrays: each distinct text is normalised once, the rest is taking by number."""
    coded = values.flatten().dictionary_encode()
    made = [forms(v) for v in coded.dictionary.to_pylist()]
    names = ("date", "amount", "id", "text", "plain", "whole")
    columns = [pa.array([m and m[i] for m in made], pa.string()) for i in range(len(names))]
    each = pa.StructArray.from_arrays(columns, names, mask=pa.array([m is None for m in made], pa.bool_()))
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(values), 0)).cast(pa.int32())
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), each.take(coded.indices), mask=values.is_null())


def forms_of(values: Column) -> Column:
    """FORMS of each text of an array."""
    return F.arrow_udf(_forms, f"array<{FORMS}>").asNondeterministic()(values)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f names it.

    Written out, the copies of a value multiply with each step, until the code of a row is too large to be compiled.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def rounded(value: Column, digits: int | None = 4) -> Column:
    """The value rounded as Python rounds: of its exact binary value, ties to even; as it is for digits=None.

    Half a step is compared with the exact product of value and 10**digits, kept in two halves of the value.
    """
    x = value.cast("double")
    if digits is None:
        return x
    scale = float(10**digits)

    def stepped(x: Column, whole: Column, high: Column) -> Column:
        over = (high * scale - (whole + 0.5)) + (x - high) * scale
        up = bound(over, lambda o: (o > 0) | ((o == 0) & (F.pmod(whole, F.lit(2)) == 1)))
        return (whole + F.when(up, 1).otherwise(0)) / scale

    def near(x: Column) -> Column:
        high = bound(x * 134217729.0, lambda y: y - (y - x))
        return F.when(F.abs(x) < 1e9, bound(F.floor(x * scale), lambda w: bound(high, lambda h: stepped(x, w, h)))).otherwise(F.bround(x, digits))

    return bound(x, near)


def form_for(field: Column, made: Column) -> Column:
    """The form that counts for a field; ``made`` is one FORMS struct."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, kind in KIND_OF_FIELD.items():
        out = out.when(field == name, made[kind])
    return out.otherwise(made["text"])


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, over code points; 1 for equal texts, 0 if just one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def stable_seed(*parts: Column) -> Column:
    """The first twelve hex digits of the SHA-256 of the parts joined by bars, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide."""
    return stable_seed(*parts) / F.lit(float(16**12))


def pick(options: Column, *parts: Column) -> Column:
    return F.element_at(options, (F.floor(uniform(*parts) * F.size(options)) + 1).cast("int"))


def has_accents(made: Column) -> Column:
    """Whether a FORMS struct's text loses accents in its plain form."""
    return made["text"] != made["plain"]


def id_of_file_name(name: Column) -> Column:
    """The document id that a file name begins with, or null."""
    found = F.regexp_extract(name, r"^((?:test|holdout|val|train|fairness)-\d{5})", 1)
    return F.when(found != "", found)


def document_kind(doc_type: Column) -> Column:
    """The family of a document type, for display."""
    return F.when(doc_type.startswith("invoice"), "Invoice").otherwise("Claim form")


def percent(x: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", x * 100), F.lit("n/a"))
