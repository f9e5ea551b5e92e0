"""Periodic runs and grammar extensions against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from talkloom.llm import periodic_runs as P, queries
from talkloom.llm.recompression import Grammar


def plain_runs(w, least=24, periods=3):
    found = set()
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, periods * q) and not any(
                    all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w[i] for i in range(n) if i not in gone)))


def some_text(rng, size):
    """Words with planted stretches that repeat, within others too."""
    alphabet = ["w%d" % i for i in range(rng.choice([1, 2, 3, 50]))]
    words = []
    while len(words) < size:
        piece = [rng.choice(alphabet) for _ in range(rng.randrange(1, 14))]
        if rng.random() < 0.3:
            piece = (piece * rng.randrange(1, 9))[:rng.randrange(1, 60)]
        if rng.random() < 0.2:
            piece = words[-rng.randrange(1, 40):] * rng.randrange(1, 4)
        words += piece
    return words[:size]


@pytest.mark.parametrize("seed", range(4))
def test_extensions(seed):
    rng = random.Random(seed)
    texts = [np.array([int(w[1:]) for w in some_text(rng, rng.randrange(1, 200))]) for _ in range(6)]
    parts = [np.array([60])]
    for k, t in enumerate(texts):
        parts += [t, np.array([61 + k])]
    s = np.concatenate(parts)
    grammar = Grammar(s, 60)
    part = np.cumsum(s >= 60)
    pairs = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if part[i] == part[j] and s[i] < 60 > s[j]]
    left, right = np.array(pairs).T
    for forward in (True, False):
        found = grammar.extensions(left, right, forward)
        for i, j, n in zip(left.tolist(), right.tolist(), found.tolist()):
            step = 1 if forward else -1
            m = 0
            while s[i + step * m] == s[j + step * m]:
                m += 1
            assert m == n


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_texts_that_share_a_grammar(seed, monkeypatch):
    rng = random.Random(seed + 10)
    monkeypatch.setattr(P, "PLACES", [1 << 20, 50, 1, 333][seed])
    texts = [some_text(rng, rng.choice([0, 1, 23, 24, 25, 72, 150, 300])) for _ in range(25)]
    texts += [texts[3], ["a"] * 24, ["a"] * 23, ["a", "b"] * 100, []]
    coded, distinct = P._numbered([[w.encode() for w in t] for t in texts])
    assert P.runs_of(coded, distinct) == [plain_runs(t) for t in texts]


def test_grammar_is_small():
    words = np.array([1] + [0] * 100_000 + [2])
    assert len(Grammar(words, 1).levels) <= 3
    rng = np.random.default_rng(1)
    once = rng.integers(0, 50, 1000)
    grammar = Grammar(np.concatenate([[50], np.tile(once, 64), [51]]), 50)
    sizes = [len(level.symbols) for level in grammar.levels]
    assert sizes[-1] < 20 and sum(sizes) < 12 * sizes[0]
    assert grammar.extensions(np.array([1]), np.array([1001])).tolist() == [63_000]


def rows():
    rng = random.Random(5)
    found = [(None, "a b " * 30), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "x " * 24), (4, "x " * 24), (5, "x y " * 24),
             (6, "É b " * 12 + "c " + "b É " * 12), (7, "\u0000 " * 30), (8, "p q r s t u v w " * 3), (9, "a " * 23)]
    return found + [(100 + i, " ".join(some_text(rng, rng.randrange(1, 250)))) for i in range(150)]


@pytest.mark.parametrize("words", [200_000, 1, 400])
def test_query_against_plain_rows(spark, tmp_path, monkeypatch, words):
    monkeypatch.setattr(P, "WORDS", words)
    documents = spark.createDataFrame([(*r, "x", "y") for r in rows()], "doc_id long, text string, runs string, collapsed string")
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([plain_row(*r) for r in rows()], key=str)
    assert any(r.n_runs > 1 for r in found) and any(r.collapsed_sha256 for r in found if r.doc_id is None)


def test_collapsed_text_and_empty_table(spark):
    documents = spark.createDataFrame([(1, "go " + "round and " * 20 + "stop")], "doc_id long, text string")
    row = P.find(documents).first()
    assert row.collapsed == "go round and stop" and [tuple(r) for r in row.runs] == [(1, 40, 2)]
    assert P.digest(P.find(documents.limit(0))).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(2)
    base = ["w%d" % rng.randrange(3000) for _ in range(70_000)]
    text = " ".join(base * 4 + ["end"] + ["z"] * 100_000)
    row = P.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (0, 280_000, 70_000) in [tuple(r) for r in row.runs] and (280_001, 100_000, 1) in [tuple(r) for r in row.runs]
