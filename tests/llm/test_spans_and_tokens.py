import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from millrace.llm.spans import Words, fold_table, span_hashes
from millrace.llm.suffix_array import long_common_prefixes, suffix_array
from millrace.llm.tokens import PartEncoder, encoder, vocabulary_path

ODD = [
    "", " ", "  a", "a  b", "a\n b", " a ", "a b  ", "\n", "x  y", "a   b", "<|endoftext|> x", "a\n\n  b\t c ",
    "\t \t", "é ü  ß\r\n q", "don't  'll x", "\x1c a b", "a\u2009 b", "a\u00a0 b", "a\u3000 b", "\u3000 a",
    "x" * 600 + " y " + "z" * 70000, "“q” r", "a.b,c;d", "1.5%", "a\n.b", "'s 's", "é.a é'a", "a\u0085 b",
]


def same_as_library(texts):
    ours = encoder(vocabulary_path())
    theirs = ours.tokenizer.encode_batch(texts, add_special_tokens=False)
    got = ours.encode([t.encode() for t in texts])
    for text, ids, want in zip(texts, got, theirs):
        assert ids.tolist() == want.ids, text[:80]


def test_ids_are_the_librarys():
    same_as_library(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'a1é\u00a0\u3000😀#<|>", max_size=30), min_size=1, max_size=4))
def test_random_ids_are_the_librarys(texts):
    same_as_library(texts)


def test_an_encoder_that_forgets_gives_the_same():
    small = PartEncoder(encoder(vocabulary_path()).tokenizer, kept_parts=5)
    texts = [f"word{i} common".encode() for i in range(40)]
    first = [ids.tolist() for text in texts for ids in small.encode([text])]
    assert first == [ids.tolist() for ids in encoder(vocabulary_path()).encode(texts)]


END = "<|endoftext|>"
WITH_ADDED = [
    END, END * 3, f"a b{END}c d", f"x {END} y", f" {END}\n\n{END} ", f"a\n{END}b", f"{END[:-1]}{END}{END[1:]}",
    "<|endoftext|", "<|ENDOFTEXT|>", f"é\u00a0{END}\u3000é", f"{'x' * 600} {END}{'y' * 600}", "", "plain text",
]


def same_as_untouched_library(texts):
    theirs = Tokenizer.from_file(vocabulary_path()).encode_batch(texts, add_special_tokens=False)
    got = encoder(vocabulary_path()).encode([t.encode() for t in texts])
    assert [ids.tolist() for ids in got] == [want.ids for want in theirs]
    assert {ids.dtype for ids in got} == {np.dtype(np.uint32)}


def test_ids_of_texts_with_added_tokens():
    assert encoder(vocabulary_path()).encode([b"a b<|endoftext|>c d"])[0].tolist() == [64, 275, 50256, 66, 288]
    same_as_untouched_library(WITH_ADDED + ODD)
    for text in WITH_ADDED + ODD:
        same_as_untouched_library([text])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([END, "<|", "|>", " ", "  ", "\n", "a", "é", "1", ".", "'s"]), max_size=9), min_size=1, max_size=4))
def test_random_ids_with_added_tokens(texts):
    same_as_untouched_library(["".join(parts) for parts in texts])


def test_added_tokens_that_are_not_their_bytes_are_refused():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.add_tokens([AddedToken("<x>", lstrip=True, normalized=False)])
    with pytest.raises(ValueError, match="<x>"):
        PartEncoder(tokenizer)


def test_words_and_their_hashes():
    table = fold_table(lambda b: b >= 128 or chr(b).isalnum())
    texts = ["The  the, THE é9!", "", "...", "x" * 200_000 + " x"]
    words = Words([t.encode() for t in texts], table)
    expected = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t in texts]
    assert words.counts.tolist() == [len(w) for w in expected]
    flat = [w for per in expected for w in per]
    assert [words.joined(i, 1).decode() for i in range(len(flat))] == flat
    assert len(set(words.hashes.tolist())) == len(set(flat))
    assert len({h for h, w in zip(words.hashes.tolist(), flat) if w == "the"}) == 1


def test_span_hashes_do_not_depend_on_place():
    x = np.frombuffer(b"abcabc" * 400_000, np.uint8)
    starts = np.arange(0, len(x), 3)
    assert len(set(span_hashes(x, starts, starts + 3).tolist())) == 1


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for turn in range(150):
        x = rng.integers(0, rng.integers(1, 5), rng.integers(1, 120)).astype(np.uint8) + 250 * (turn % 2)
        x = np.tile(x.astype(np.uint8), 3 if turn % 5 == 0 else 1)
        raw = x.tobytes()
        order = suffix_array(x, len(raw)).tolist()
        assert order == sorted(range(len(raw)), key=lambda i: raw[i:])
        span = 8 + turn % 9
        shared = long_common_prefixes(x, np.array(order), span)
        for before, at in zip(order, order[1:]):
            assert shared[at] == (len(raw) >= max(at, before) + span and raw[at : at + span] == raw[before : before + span])
    assert len(suffix_array(np.empty(0, np.uint8), 10)) == 0


