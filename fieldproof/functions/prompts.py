"""Extraction prompts by version, and their hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from ..constants import FIELD_DESCRIPTIONS, FIELDS, PAGE_HEIGHT, PAGE_WIDTH, PROMPT_VERSION

# The example that version 2 shows, and the templates. Their text is hashed, so it must not change.
_EXAMPLE = {
    "claim_number": {"value": "CLM-2025-004817", "evidence_text": "CLM-2025-004817", "page": 1, "bbox": [212, 188, 391, 210]},
    "claimant_name": {"value": "Jane Doe", "evidence_text": "Jane Doe", "page": 1, "bbox": [248, 142, 340, 164]},
    "date_of_loss": {"value": "2025-03-14", "evidence_text": "03/14/2025", "page": 1, "bbox": [212, 402, 318, 424]},
    "total_amount": {"value": "1240.55", "evidence_text": "$1,240.55", "page": 1, "bbox": [800, 610, 890, 632]},
}
_FIRST_EXAMPLE = {"claim_number": _EXAMPLE["claim_number"], "date_of_loss": _EXAMPLE["date_of_loss"], "provider_name": None}
_FIRST = """You are extracting information from a scanned insurance claim document.
The image is {width} x {height} pixels.

Return ONLY a JSON object with exactly these keys:
{fields}

For each key, return either null (if the information is NOT on the document) or an object:
  {{"value": ..., "evidence_text": ..., "page": 1, "bbox": [x0, y0, x1, y1]}}
where
  - "value" is the normalised value: dates as YYYY-MM-DD, amounts as a plain number like 1240.55,
    other text exactly as written;
  - "evidence_text" is the text copied exactly as it appears on the page;
  - "bbox" is the pixel box around that text (top-left x0,y0 and bottom-right x1,y1).

Never guess. If a field is not on the document, use null.

Example of the format (values are illustrative only):
{example}
"""
_SECOND = """You are extracting information from a scanned insurance claim document.
The image is {width} x {height} pixels.

Fields to extract:
{fields}

Output rules:
1. Return ONE JSON object (not a list) with ALL {count} keys above, in that order.
2. Each key is either null (the information is NOT on the document) or
   {{"value": ..., "evidence_text": ..., "page": 1, "bbox": [x0, y0, x1, y1]}}
   - value: dates as YYYY-MM-DD, amounts as a plain number like 1240.55, other text exactly as written
   - evidence_text: the text copied exactly as printed on the page
   - bbox: pixel box around the VALUE itself (not its label), top-left x0,y0 to bottom-right x1,y1
3. Write each field on ONE line, exactly like the example. Finish the whole object.
4. Never guess. If a field is not on the document, use null.

Example (values are illustrative only):
{example}
"""


def one_field_per_line(values: dict[str, dict | None]) -> str:
    """JSON of all fields in order, one to a line, absent ones as null."""
    rows = (f'  "{name}": ' + ("null" if not values.get(name) else json.dumps(values[name], ensure_ascii=False, separators=(", ", ": "))) for name in FIELDS)
    return "{\n" + ",\n".join(rows) + "\n}"


def _fields() -> str:
    return "\n".join(f"- {name}: {text}" for name, text in FIELD_DESCRIPTIONS.items())


BUILDERS: dict[str, Callable[[int, int], str]] = {
    "v1": lambda width, height: _FIRST.format(width=width, height=height, fields=_fields(), example=json.dumps(_FIRST_EXAMPLE, indent=1)),
    "v2": lambda width, height: _SECOND.format(width=width, height=height, fields=_fields(), count=len(FIELDS), example=one_field_per_line(_EXAMPLE)),
}


def build_prompt(width: int, height: int, version: str = PROMPT_VERSION) -> str:
    return BUILDERS[version](width, height)


def prompt_hash(width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT, version: str = PROMPT_VERSION) -> str:
    return hashlib.sha256(build_prompt(width, height, version).encode()).hexdigest()[:16]
