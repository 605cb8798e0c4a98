"""Byte-level BPE encoding and decoding as a tree reduction.

A text is cut in halves down to leaves; a leaf is matched by the splitting pattern and each match is merged by ranks.
Neighbours are joined in a window at their boundary that grows until what lies outside can't change:

* Between texts (:meth:`Tokenizer.matches`): the pattern keeps no state from one match to the next and looks at most
  ``look`` characters ahead of a match's start or one past its end. A left match that ends, and looks, before the end
  of its text is therefore final. Once the window's matches and the right text's own matches share a boundary, all that
  follows is final too.
* Within one match (:meth:`Tokenizer.piece`): a token sequence is the encoding of its bytes if and only if each two
  neighbouring tokens are the encoding of theirs. If the re-encoded window begins with the token that began it before
  and ends with the token that ended it, every neighbouring pair outside is one that was valid already.

Decoding concatenates the bytes of tokens, of leaves, and up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import kernels as K
from .shared import text_column

#: A vocabulary file larger than this is not sent to executors.
MOST_FILE_BYTES = 64 << 20
_FAR = 1 << 60


class _Pieces(dict):
    """Token ids by match; unknown ones are encoded and kept, up to a bound."""

    def __init__(self, encode, bound: int):
        self.encode, self.bound = encode, bound

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = tuple(self.encode(match.encode()))
        if len(match) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[match] = ids
        return ids


class Tokenizer:
    """Encoder and decoder for one rank file (base64 token and rank per line)."""

    def __init__(self, ranks_file: bytes, pattern: str, leaf_chars: int = 16384, leaf_bytes: int = 48, long_bytes: int = 4096, look: int = 3, cache: int = 400_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.text = {b: str(b) for b in self.tokens}
        self.pattern = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes, self.long_bytes, self.look = leaf_chars, leaf_bytes, long_bytes, look
        self.pieces = _Pieces(self.piece, cache)

    def merged(self, raw: bytes) -> list[int]:
        """Ranks merged lowest first, leftmost of equals, over a byte string."""
        known = self.ranks.get(raw)
        if known is not None:
            return [known]
        if len(raw) > 2 * self.leaf_bytes:
            return self._merged_long(raw)
        rank = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i : i + 2], _FAR) for i in range(len(raw) - 1)]
        while pairs:
            low = min(pairs)
            if low == _FAR:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _FAR)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _FAR)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, raw: bytes) -> list[int]:
        """The same over a long string: the pairs wait in a heap of (rank, place), parts are a linked list of places."""
        rank, n = self.ranks.get, len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the part at i ends where the next one begins
        heap = [(r, i) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        open_rank = [-1] * n  # the rank of the pair that begins at a place, -1 for none or a part that is gone
        for r, i in heap:
            open_rank[i] = r
        while heap:
            r, i = heapq.heappop(heap)
            if open_rank[i] != r:
                continue
            j = after[i]
            end = after[j]
            after[i], open_rank[j], open_rank[i] = end, -1, -1
            if end < n:
                before[end] = i
                found = rank(raw[i : after[end]])
                if found is not None:
                    open_rank[i] = found
                    heapq.heappush(heap, (found, i))
            k = before[i]
            if k >= 0:
                found = rank(raw[k:end])
                open_rank[k] = -1 if found is None else found
                if found is not None:
                    heapq.heappush(heap, (found, k))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return out

    def piece(self, raw: bytes, leaf: int = 0) -> list[int]:
        """The tokens of one match; a very long one has larger leaves, as its joins may each re-encode all of it."""
        leaf = leaf or (self.leaf_bytes if len(raw) <= self.long_bytes else self.long_bytes)
        if len(raw) <= leaf:
            return self.merged(raw) if raw else []
        half = len(raw) // 2
        return self.join(self.piece(raw[:half], leaf), self.piece(raw[half:], leaf))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of the concatenated bytes of two encodings."""
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            window = self.decode(a) + self.decode(b)
            made = self.merged(window)
            if (len(a) == len(left) or made[0] == a[0]) and (len(b) == len(right) or made[-1] == b[-1]):
                return left[: len(left) - len(a)] + made + right[len(b) :]
            k *= 4

    def matches(self, text: str) -> list[str]:
        """The pattern's matches over the text, from halves."""
        if len(text) <= self.leaf_chars:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self._join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def _join_matches(self, left: list[str], right: list[str]) -> list[str]:
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            before, after = "".join(a), "".join(b)
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if whole_left or len(before) > self.look + len(a[0]):
                # a[0] starts at a final boundary: the match before it ends and looks inside the left text
                window = before + after
                own, at = set(), len(before)
                for m in b:
                    own.add(at)
                    at += len(m)
                made, start = [], 0
                for m in self.pattern.findall(window):
                    if start >= len(before) and start in own and start > 0:
                        seen = sum(1 for x in own if x < start)
                        return left[: len(left) - len(a)] + made + right[seen:]
                    if not whole_right and (start + self.look > len(window) or start + len(m) >= len(window)):
                        break
                    made.append(m)
                    start += len(m)
                else:
                    if whole_right:
                        return left[: len(left) - len(a)] + made
            k *= 2

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.matches(text))))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 65536:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_built: dict[tuple, Tokenizer] = {}


def _tokenizer(file: bytes, pattern: str) -> Tokenizer:
    key = hashlib.sha256(file + pattern.encode()).digest()
    if key not in _built:
        _built[key] = Tokenizer(file, pattern)
    return _built[key]


def _vocabulary(docs: DataFrame, path: str):
    raw = Path(path).read_bytes()
    if len(raw) > MOST_FILE_BYTES:
        raise ValueError(f"{path}: {len(raw)} bytes; at most {MOST_FILE_BYTES} are sent to executors")
    return docs.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row; a null or empty text has no ids. Special tokens are ordinary text."""
    file = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(file.value, pattern)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t.encode(x or "") for x in part.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) per row of ids; null ids read as none. An id that the vocabulary lacks raises KeyError."""
    file = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(file.value, "")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes decoded from the ids).

    One row per row of docs; a null text reads as empty.
    """
    file = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(file.value, pattern)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                count, ids_sha, raw_sha = [], [], []
                for x in part.column("text").to_pylist():
                    ids = t.encode(x or "")
                    count.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(t.text.__getitem__, ids)).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(t.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
