"""Secret scans: three fixed patterns, and novelty under a dictionary-primed zstandard compressor.

A candidate is an unbroken string of 16 characters or more within 48 characters of a sensitive word, on either side.
Its novelty is what it adds to the compressed size of the text around it, under a raw-content dictionary: of code and
identifiers where it has digits, of those and ordinary words where it has only letters (and signs). What the dictionary
and the surroundings explain adds few bytes; a random string adds nearly its own information.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import kernels as K
from .shared import text_column

#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
LEAST_CHARS, NEAR = 16, 48
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
_SENSITIVE = re.compile(r"passw|passphrase|secret|token|api_?key|access_?key|private_?key|credential|bearer|authorization|signature|client_?id", re.IGNORECASE | re.ASCII)
_SENSITIVE_WORDS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "authorization", "signature", "client")

#: What code around a secret usually holds.
IDENTIFIERS = b"""
import os import sys from typing import return None self.client = Client( def main(args): public static final String
const let var function export default new require process.env environment config settings options request response
username user_id account email address database host port localhost connection string timeout version production
password passwd secret token api_key apikey access_key private_key client_id client_secret credential authorization
bearer signature key value default example changeme placeholder your_token_here your_api_key_here insert_key_here
xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000000000000000000000000000 1234567890123456789012345678901234567890
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef 0123456789ABCDEF aaaaaaaaaaaaaaaaaaaaaaaa
https://www.example.com/index.html application/json content-type text/plain charset=utf-8 user-agent mozilla
"""


#: Least share of its length that a string without digits must add: of one case, of one case from 36 characters (where
#: literals are entropy-coded), of both cases. About one in a hundred random strings adds less; ordinary long words,
#: compounds and identifiers add less than these.
LETTERS_LEAST = (0.82, 0.71, 0.85)
LETTERS_LONG = 36


def ordinary_words() -> bytes:
    """The words and long parts of words of a public vocabulary of several languages."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        tokens = {base64.b64decode(x.split()[0]).strip() for x in lines if x.strip()}
    return b" ".join(sorted(t for t in tokens if len(t) >= 5 and t.isalpha()))


class Novelty:
    """Marginal compressed bytes of a string within its surroundings."""

    def __init__(self, dictionary: bytes = IDENTIFIERS, before: int = 256, after: int = 64):
        self.before, self.after = before, after
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def bytes_added(self, text: str, start: int, end: int, lower: bool = False) -> int:
        left, own, right = text[max(0, start - self.before) : start], text[start:end], text[end : end + self.after]
        return self.size(left + (own.lower() if lower else own) + right) - self.size(left + right)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _is_novel(text: str, start: int, end: int, novelty: Novelty, wordy: Novelty, least_share: float) -> bool:
    s = text[start:end]
    if any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
        return novelty.bytes_added(text, start, end) >= least_share * len(s)
    one_case = s == s.lower() or s == s.upper()
    least = LETTERS_LEAST[2 if not one_case else 1 if len(s) >= LETTERS_LONG else 0]
    # the vocabulary is in lower case
    return wordy.bytes_added(text, start, end, one_case and s != s.lower()) >= least * len(s)


def candidates(text: str, near: int = NEAR) -> list[tuple[int, int]]:
    """(start, end) of unbroken strings within ``near`` characters after or before a sensitive word, in time linear in
    the text: runs are found once, and each word looks at the few runs beside it.

    A run that a word lies in counts from the word's end, or up to its beginning.
    """
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    if not runs:
        return []
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in runs], [b for _, b in runs]
    found, done = [], 0
    for _, after in words:
        for k in range(bisect_left(ends, after + 1), len(runs)):
            a = max(runs[k][0], after, done)
            if a > after + near:
                break
            if runs[k][1] - a >= LEAST_CHARS:
                found.append((a, runs[k][1]))
                done = runs[k][1]
    taken, gap = [b for _, b in found], 0  # in order, as these don't overlap
    own = list(found)
    for before, after in words:
        for k in range(bisect_left(starts, before) - 1, -1, -1):
            a, b = max(runs[k][0], gap), min(runs[k][1], before)
            if b + near < before or runs[k][1] <= gap:
                break
            at = bisect_left(taken, a + 1)
            if b - a >= LEAST_CHARS and not (at < len(own) and own[at][0] < b):
                found.append((a, b))
        gap = after
    return found


def novel_spans(text: str, novelty: Novelty, wordy: Novelty, near: int = NEAR, least_share: float = 0.55) -> list[tuple[int, int, int]]:
    """(start, 3, end) of candidates that add at least their share to the compressed size: ``least_share`` with digits,
    LETTERS_LEAST without."""
    low = text.lower()
    if not any(w in low for w in _SENSITIVE_WORDS):
        return []
    return [(a, 3, b) for a, b in candidates(text, near) if _is_novel(text, a, b, novelty, wordy, least_share)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_share: float = 0.55) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel for each row.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null, empty or blank text has
    none, so its base_sha256 is that of the empty string. Rows of one doc_id are scanned each for itself; an empty
    table gives an empty result.
    """

    vocabulary = ordinary_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty, wordy = Novelty(), Novelty(vocabulary + IDENTIFIERS)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                counts: tuple[list[int], ...] = ([], [], [], [])
                shas, spans = [], []
                for x in part.column("text").to_pylist():
                    base = base_spans(x or "")
                    every = sorted(base + novel_spans(x or "", novelty, wordy, least_share=least_share))
                    for k, c in enumerate(counts):
                        c.append(sum(s[1] == k for s in every))
                    shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(every))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
