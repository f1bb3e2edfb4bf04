"""Byte-level BPE against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from preyscope.llm import byte_bpe, queries
from preyscope.llm.common import documents

from .helpers import corpus, frame, rows_of, run, sha, with_extra

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return byte_bpe.Vocabulary(f.read())


def expected(library, key, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return key, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))


def agree(vocabulary, library, texts):
    coded = vocabulary.encode(texts)
    for text, own, decoded in zip(texts, coded, vocabulary.decode(coded), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own, "<u4").tolist() == ids, text[:100]
        assert decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_every_character_is_cut_as_by_the_library(vocabulary):
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(characters), 100_000):
        # Every character of few tables, one in twenty of the planes of ideographs and private use.
        text = "".join(f"a{c}1!{c}" for k, c in enumerate(characters[at : at + 100_000]) if at < 100_000 or k % 20 == 0)
        own = (vocabulary.older_words if vocabulary.newer else vocabulary.words).findall(text)
        assert own == [text[a:b] for _, (a, b) in split.pre_tokenize_str(text)]
    known = "".join(f"a{c}1!{c}" for c in characters[:0x20000] if c not in vocabulary.newer)
    assert vocabulary.words.findall(known) == vocabulary.older_words.findall(known)


def test_random_texts(vocabulary, library):
    rng = random.Random(3)
    letters = [*map(chr, range(0x20, 0x7F)), *" \n\t\x0b\x1c\x85\xa0éßñ😀中文字ـ١Ⅷ‍�", "<|endoftext|>", "<|endof", "'s", "'LL", "'ll", "  ", *sorted(vocabulary.newer)[::900]]
    for _ in range(3):
        agree(vocabulary, library, ["".join(rng.choices(letters, k=rng.randrange(90))) for _ in range(2000)])


def test_long_words_are_merged_whole(vocabulary, library):
    rng = random.Random(4)
    words = ["a" * 5001, "ab" * 900, " " * 3000, "é" * 700, "‍" * 500, "=" * 257, "".join(rng.choices("abcdefghij", k=30_000)), "".join(rng.choices("ae", k=3000))]
    agree(vocabulary, library, [*words, " ".join(words), "\n\n".join(words)])
    for n in (byte_bpe.LONG - 1, byte_bpe.LONG, byte_bpe.LONG + 1):
        word = "".join(rng.choices("estion", k=n))
        assert vocabulary.merge_long(word.encode()) == vocabulary.merge_many([word.encode()])[0]
    assert sum(map(len, vocabulary.decode(vocabulary.encode(["x" * 1_000_000])))) == 1_000_000


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    with open(PATH, "rb") as f:
        small = byte_bpe.Vocabulary(f.read())
    rng = random.Random(5)
    for _ in range(20):
        agree(small, library, [" ".join(str(rng.randrange(300)) for _ in range(40)), "again and again"])
    assert len(small.known) < 400 and len(small.older) < 400


def test_other_vocabularies_are_refused(vocabulary):
    with open(PATH) as f:
        file = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": file["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError, match="plain byte-level"):
            byte_bpe.Vocabulary(json.dumps(file | change).encode())
    merges = file["model"]["merges"]
    with pytest.raises(ValueError, match="token of its own"):
        byte_bpe.Vocabulary(json.dumps(file | {"model": file["model"] | {"merges": merges[::-1]}}).encode())


def test_rows(spark, library):
    texts = [*corpus(n=20), "x<|endoftext|><|endoftext|> y", "﻿a\r\n", "a" * 70_000]
    rows = rows_of(texts)
    rows += [rows[3], (None, "no id", None, None, None), (None, None, None, None, None)]
    found = run(byte_bpe.encode_decode(with_extra(frame(spark, rows)), PATH, ids_column=None))
    assert found == sorted((expected(library, r[0], r[1]) for r in rows), key=repr)
    with_ids = byte_bpe.encode_decode(frame(spark, rows_of(["", None, "to be"])), PATH).select("doc_id", "ids").collect()
    assert sorted(map(tuple, with_ids)) == [(0, []), (1, []), (2, library.encode("to be").ids)]
    assert run(byte_bpe.encode_decode(frame(spark, []), PATH)) == []


def test_registered_query(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = documents(spark, folder).select("doc_id", "text").collect()
    assert run(queries.op11_byte_bpe(spark, folder)) == sorted((expected(library, r[0], r[1]) for r in rows), key=repr)
