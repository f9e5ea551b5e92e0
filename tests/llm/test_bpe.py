"""Encoding against the tokenizers library, text by text."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talkloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_round_trip(spark, library):
    rng = random.Random(2)
    parts = ["the", " the", "don't", "'ll", "  ", "\n\n", "\t", "é", "日本語", "…", "<|endoftext|>", "<|endof", "\u0000", "🙂", " ",
             "12", "½", "x" * 50, "՘", "꟒", "\U0001f9ff"]
    texts = [None, "", " ", "<|endoftext|>", " a <|endoftext|> b", "same words same words", "same words same words", "z" * 300_000, "w " * 50_000]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 80))) for _ in range(80)]
    rows = [(i if i != 5 else None, t, "clash") for i, t in enumerate(texts)] + [(3, "the id again", "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    found = bpe.encode(documents, PATH).collect()
    expected = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in found) == sorted(expected)


def test_many_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    rows = [(i, f"word{i % 7} and some more {i}") for i in range(40)]
    found = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, parts=3).collect()
    assert {r.doc_id: list(r.ids) for r in found} == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_split_on_every_kind_of_character(library):
    split = bpe.Splitter(library)
    for c in [*range(0x600), *range(0xA700, 0xA800), *range(0x2000, 0x2100), 0x1F9FF, 0x323B0, 0x10FFFF]:
        text = f"a{chr(c)}1 {chr(c)}"
        assert split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)
