"""Token counts after edits against counting the edited text anew."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from talkloom.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return T.Counter(T.read_ranks(PATH))


@pytest.fixture(scope="module")
def full():
    ranks = T.read_ranks(PATH)
    encoding = tiktoken.Encoding("full", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _text(rng, n):
    words = ["the", "a", "it's", "don't", "123", "4,5", "  ", "\n\n", "\t", "é", "日本", "...", "'", " ", "x" * 30, "🙂", "\n "]
    return "".join(rng.choice(words) + rng.choice([" ", "", " ", "\n", "   "]) for _ in range(n))


def _sums_hold(tree):
    for sums in (tree.chars, tree.tokens):
        for i in range(1, tree.size):
            assert sums[i] == sums[2 * i] + sums[2 * i + 1]


def test_planted_tree_has_the_count(counter, full):
    rng = random.Random(1)
    for n in (0, 1, 5, 64, 300, 2000):
        text = _text(rng, n)
        tree = T.plant(text, counter)
        assert tree.n_tokens == full(text) and tree.chars[1] == len(text)
        _sums_hold(tree)


@pytest.mark.parametrize("seed", range(40))
def test_any_edits_give_the_count_of_the_new_text(counter, full, seed):
    rng = random.Random(seed)
    text = _text(rng, rng.choice([0, 3, 40, 700]))
    tree = T.plant(text, counter)
    for _ in range(12):
        start = rng.choice([0, len(text), rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)])
        length = rng.choice([0, 0, 1, 2, 30, 500])
        new = rng.choice(["", "", "s", " ", "\n", "'", "ll", _text(rng, 3), _text(rng, 400)])
        expected = text[:start] + new + text[start + length:]
        tree, text, _ = T.edit(tree, text, start, length, new, counter)
        assert text == expected
        assert tree.n_tokens == full(text), (start, length, new)
        assert tree.chars[1] == len(text)
        _sums_hold(tree)


def test_a_small_edit_encodes_a_small_region(counter):
    text = "some words go here and there, " * 5000
    tree, _, again = T.edit(T.plant(text, counter), text, 70_000, 4, "other", counter)
    assert again < 2000


def test_white_space_runs_and_whole_deletion(counter, full):
    text = " " * 5000 + "x" + "\n" * 5000
    tree = T.plant(text, counter)
    assert tree.n_tokens == full(text)
    tree, text, _ = T.edit(tree, text, 5000, 1, "", counter)
    assert tree.n_tokens == full(text)
    tree, text, _ = T.edit(tree, text, 0, len(text), "", counter)
    assert text == "" and tree.n_tokens == 0
    tree, text, _ = T.edit(tree, text, 0, 0, "new words", counter)
    assert tree.n_tokens == full("new words")


def test_rows(spark, full):
    rows = [
        (1, "mail a.b@example.org and call +1 555 123 4567 now", "x"), (2, "nothing private, but 3 digits 123", "x"),
        (3, None, "x"), (4, "", "x"), (1, "mail a.b@example.org and call +1 555 123 4567 now", "x"),
        (1, "another version of c@example.org", "x"), (None, "d@example.org", "x"), (5, "word " * 20000 + "e@example.org", "x"),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string, version string")
    trees = T.build(documents, PATH)
    found = T.counts_after(trees, T.scrubbing(documents), PATH).collect()
    assert len(found) == len(rows)
    before = sorted((str(i), full(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == before
    after = {
        1: {full("mail [email] and call [phone] now"), full("another version of [email]")}, 2: {full(rows[1][1])},
        3: {0}, 4: {0}, None: {full("d@example.org")}, 5: {full("word " * 20000 + "[email]")},
    }
    assert {i: {r.n_tokens_after for r in found if r.doc_id == i} for i in after} == after
    assert {r.doc_id: r.n_edits for r in found}[5] == 1


def test_overlapping_and_outlying_edits(spark, full):
    rows = [(1, "abcdefgh ijkl", [(2, 4, "X"), (4, 2, "Y"), (50, 3, "Z"), (0, 0, None)])]
    schema = "doc_id long, text string, edits array<struct<start:int,length:int,replacement:string>>"
    edits = T.versions(spark.createDataFrame(rows, schema)).join(
        spark.createDataFrame(rows, schema).select("doc_id", "edits"), "doc_id")
    trees = T.build(spark.createDataFrame(rows, schema), PATH)
    got = T.recount(edits.join(trees, ["doc_id", "version"]), PATH).first()
    assert got.text == "abXYgh ijklZ" and got.tokens[1] == full(got.text)


def test_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    assert T.counts_after(T.build(documents, PATH), T.scrubbing(documents), PATH).where(F.lit(True)).collect() == []
