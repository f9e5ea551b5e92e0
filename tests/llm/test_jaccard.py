"""Links and components against all pairs of texts."""

import random
import re

import numpy as np
import pytest

from talkloom.llm import jaccard as J, shingles


def plain(rows):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)]) if w else frozenset())
    group = list(range(len(rows)))
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and None not in (a, rows[j][0]) and 100 * both >= 90 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            first[g] = min(first.get(g, doc), doc)
    return sorted((str(doc), len(s), str(first.get(g))) for (doc, _), s, g in zip(rows, sets, group))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def corpus(seed, groups=12, words=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "w%d" % rng.randrange(3000)
    rows = [(None, "no id at all here"), (500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "two words"),
            (506, "two words"), (507, "a b c"), (507, "a b c"), (507, "quite another text"), (508, "A b C"), (509, "É b c"), (510, "é b c")]
    passage = [word() for _ in range(50)]
    i = 0
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(9, words))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(text) + 1)
                text[at:at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
            rows.append((1000 - i, " ".join(text)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "CHUNK_SETS", [64, 3, 5, 2, 8][seed])
    monkeypatch.setattr(J, "LOWEST", [8, 1, 2, 1, 3][seed])
    monkeypatch.setattr(J, "COMMON", [6, 2, 3, 5, 2][seed])
    monkeypatch.setattr(J, "COMMON_PART", [16, 1, 1, 2, 1][seed])
    monkeypatch.setattr(J, "AT_ONCE", [2_000_000, 1, 500, 10, 3000][seed])
    rows = corpus(seed)
    documents = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, leaf string")
    assert found(J.join(documents)) == plain(rows)


def test_large_sets_with_few_differences(spark):
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(10**6) for _ in range(3000)]
    rows = []
    for i, edits in enumerate([0, 40, 48, 55, 60, 80, 120, 200]):
        text = list(base)
        for at in rng.sample(range(len(base)), edits):
            text[at] = "e%d" % rng.randrange(10**9)
        rows.append((i, " ".join(text)))
    assert found(J.join(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("per_cent", [70, 80, 90, 95, 99])
def test_keys_of_linked_sets_meet(per_cent):
    rng = np.random.default_rng(per_cent)
    met = 0
    for _ in range(3000):
        union = np.unique(rng.integers(0, 2**64, rng.integers(2, 400), dtype=np.uint64))
        torn = rng.permutation(len(union))[:rng.integers(1, 2 + len(union) * (100 - per_cent) // 100)]
        if rng.random() < 0.3:
            # Differences side by side, or all in one of the sets.
            torn = np.arange(len(torn)) + rng.integers(0, len(union) - len(torn) + 1)
        side = rng.integers(0, 2, len(torn)).astype(bool) & bool(rng.random() < 0.8)
        a, b = np.delete(union, torn[side]), np.delete(union, torn[~side])
        common = np.sort(rng.permutation(union)[:rng.integers(0, len(union)) if rng.random() < 0.5 else 0])
        if len(torn) and len(a) and len(b) and J.linked(len(union) - len(torn), len(a), len(b), per_cent):
            assert len(torn) <= J.differences(len(a), len(b), per_cent)
            keys = [set(J.keys_of(s, common, per_cent).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]
            met += 1
    assert met > 300


def test_keys_are_few():
    rng = np.random.default_rng(1)
    for per_cent, share in ((90, 0.21), (80, 0.5)):
        sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in rng.integers(60, 2000, 300)]
        assert sum(len(J.keys_of(s, np.zeros(0, np.uint64), per_cent)) for s in sets) <= share * sum(map(len, sets))


def test_many_near_copies_of_one_text(spark):
    """Thousands of near copies, some of which link only by way of others; chunk pairs stay few."""
    rng = random.Random(12)
    base = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    rows = []
    for i in range(3000):
        text = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 1, 1])):
            text[at] = "e%d" % rng.randrange(10**9)
        rows.append((i, " ".join(text)))
    # A chain that starts at the group, and a group of its own beside it.
    chain = list(base)
    for i in range(8):
        chain[15 * i] = "c%d" % i
        rows.append((5000 + i, " ".join(chain)))
    other = ["o%d" % k for k in range(100)] + base[:20]
    rows += [(6000 + i, " ".join(other[:-i or None])) for i in range(3)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in J.join(documents).collect()}
    assert {found[i] for i in range(3000)} == {0} and {found[5000 + i] for i in range(8)} == {0}
    assert {found[6000 + i] for i in range(3)} == {6000}


def test_pieces_do_not_change_the_hashes(monkeypatch):
    text = "Some words\x0band\tothers " * 50 + "é" * 40
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 7)
    assert (shingles.word_hashes(text) == whole).all()
    assert len(whole) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
