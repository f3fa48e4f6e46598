"""Code points on which Python and the library differ, and words without an end in sight."""

import random
import time
import unicodedata

import pytest
from tokenizers import Tokenizer

from corpusmill.llm import bpe
from tests.llm.test_operators import WORD_BPE


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    return [[int(i) for v in values for i in v[1].split()] for values in bpe.encoder(WORD_BPE).encode(texts)]


def every(good):
    return [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and good(chr(c))]


def test_every_mark_beside_marks_of_all_classes(library):
    marks, by_class = every(unicodedata.combining), {}
    for m in marks:
        by_class.setdefault(unicodedata.combining(m), m)
    some = [by_class[k] for k in (1, 7, 8, 9, 10, 202, 220, 230, 232, 234, 240)]
    texts = ["a" + x for m in marks for q in some for x in (m + q, q + m)]
    rng = random.Random(0)
    texts += ["e" + "".join(rng.choice(marks) for _ in range(3)) + " b" for _ in range(5000)]
    for i in range(0, len(texts), 5000):
        assert ours(texts[i : i + 5000]) == library(texts[i : i + 5000])


def test_every_composition_and_lower_case(library):
    split = every(lambda c: unicodedata.decomposition(c) and "<" not in unicodedata.decomposition(c))
    texts = [x for c in split for x in (c, unicodedata.normalize("NFD", c), "x" + unicodedata.normalize("NFD", c) + "́")] + [f"x{c}y" for c in every(lambda c: c.lower() != c)]
    assert ours(texts) == library(texts)


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghij", "é#ß"])
def test_long_words(library, letters):
    rng = random.Random(len(letters))
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (bpe.LONG, bpe.LONG + 1, 5000)] + ["short " + letters * 400 + " words"]
    assert ours(texts) == library(texts)


def test_a_word_of_two_million_letters(library):
    rng = random.Random(1)
    text, began = "".join(rng.choice("abcdefghij") for _ in range(2_000_000)), time.time()
    got = ours([text])
    assert time.time() - began < 120 and got == library([text])
