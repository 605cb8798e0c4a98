import time

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldproof.llm.byte_bpe import Tokenizer

FILE = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
T = Tokenizer(FILE, P.PATTERN, leaf_chars=7, leaf_bytes=3, long_bytes=64)
BIG = Tokenizer(FILE, P.PATTERN)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=T.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'strevmldab1é漢.,! "), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_same_ids_as_the_library_and_exact_round_trip(text):
    for t in (T, BIG):
        ids = t.encode(text)
        assert ids == REF.encode_ordinary(text)
        assert t.decode(ids).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdehilnorstuéñ", min_size=1, max_size=400))
def test_one_long_match_from_halves(word):
    assert T.piece(word.encode()) == REF.encode_ordinary(word)


@pytest.mark.parametrize("text", ["", " ", "\n\n\n", "a" * 3000, "they'll we've it's " * 2000, " " * 5000 + "x", "<|endoftext|>", "don'" + "t" * 50, "x" + "  \n  " * 3000 + "'re"])
def test_edges(text):
    for t in (T, BIG):
        assert t.encode(text) == REF.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=600), st.integers(1, 4))
def test_the_heap_merges_as_the_plain_rule_does(raw, repeat):
    raw = raw[:150] * repeat
    plain = Tokenizer.__new__(Tokenizer)
    plain.__dict__.update(T.__dict__, leaf_bytes=10**9)
    assert T._merged_long(raw) == plain.merged(raw) or raw in T.ranks


@pytest.mark.parametrize("text", ["a" * 40_000, "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(200_000))])
def test_very_long_matches_take_little_time(text):
    began = time.perf_counter()
    ids = BIG.encode(text)
    assert time.perf_counter() - began < 20
    assert BIG.decode(ids).decode() == text and (len(text) > 50_000 or ids == REF.encode_ordinary(text))
