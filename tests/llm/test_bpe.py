import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sunloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(PATH)
    tool.no_truncation()
    tool.no_padding()
    return tool


@pytest.fixture(scope="module")
def tool():
    return bpe.Bpe(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_equals_the_library(spark, small, documents, library):
    made = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op12_contiguous_bpe"](spark, small).collect()}
    assert made == {r.doc_id: wanted(library, r.text) for r in documents.collect()}


def test_odd_and_empty_tables(odd, empty, library):
    made = sorted(tuple(r)[1:] for r in bpe.round_trip(odd, PATH).collect())
    assert made == sorted(wanted(library, r.text) for r in odd.collect())
    assert bpe.round_trip(empty, PATH).collect() == []


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", " etaoinshr", "e漢字ŝжд\u0085 😀 '’\n\t12", ["<|endoftext|>", " ", "<|", "a", "|>"], "'stremvdl ", "\x00\x1c​ ﻿ x"]


@pytest.mark.parametrize("seed", range(len(ALPHABETS)))
def test_random_texts(tool, library, seed):
    rng = random.Random(seed)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABETS[seed]) for _ in range(rng.randint(0, 80)))
        ids = np.frombuffer(tool.encode(text), "<i4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert tool.decode(ids) == text


def test_any_ids_decode_as_the_library_does(tool, library):
    for seed in range(200):
        ids = np.random.default_rng(seed).integers(0, 50257, 40)
        assert tool.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert tool.decode(np.array([-1, 50257, 2**31 - 1])) == ""


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "a漢é"])
def test_long_words_merge_as_short_ones(tool, letters):
    rng = random.Random(len(letters))
    for n in (1, 2, 3, 7, 50, 599, 600, 601, 2500):
        raw = "".join(rng.choice(letters) for _ in range(n)).encode()
        assert tool.scan(raw).tolist() == tool.by_rank(raw).tolist()


def test_a_word_of_two_megabytes(tool, library):
    rng = random.Random(5)
    word = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/") for _ in range(1 << 21))
    assert np.frombuffer(tool.encode(word), "<i4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_words_that_are_forgotten_are_merged_again(library, monkeypatch):
    monkeypatch.setattr("sunloom.llm.tokens.CACHE_WORDS", 5)
    tool = bpe.Bpe(PATH)
    for k in range(40):
        text = f"some words {k} and words {k * k} again"
        assert np.frombuffer(tool.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_portions_hold_every_row():
    assert list(bpe._portions([])) == []
    assert list(bpe._portions([1 << 21, 5, 7, 1 << 21, 1])) == [(0, 1), (1, 3), (3, 4), (4, 5)]


def test_other_columns_are_carried(odd):
    made = bpe.encode(odd, PATH, keep=("doc_id", "source", "digest"))
    assert made.columns == ["doc_id", "source", "digest", "ids"] and made.count() == odd.count()
