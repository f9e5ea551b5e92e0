"""Quality figures against a plain count, and the votes' estimation against a plain EM."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from talkloom.llm import quality as Q


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_figures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c d e f g h a b c d e f g h", "x " * 40, "   é日本 🙂", "#*$%&|<> a|b",
             "same line here\nsame line here\n \n\n", "w " * 200_000]
    for _ in range(60):
        texts.append(" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "\r\n x\n x\n x"]))
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", "", "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_words string, _text string")
    found = {r.doc_id: r for r in Q.figures(documents).collect()}
    assert len(found) == len(rows)
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_figures(text), text


def plain_em(patterns, rules):
    prior, good, bad = Q.PRIOR, [Q.ACCURACY] * rules, [Q.ACCURACY] * rules
    for _ in range(Q.STEPS):
        shares = []
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                if v is not None:
                    odds += math.log(good[j] / (1 - bad[j])) if v else math.log((1 - good[j]) / bad[j])
            shares.append(n / (1 + math.exp(-odds)))
        total = sum(n for _, n in patterns)
        pseudo = Q.PSEUDO * total

        def right(j, vote, mass):
            cast = sum(m for m, (votes, _) in zip(mass, patterns) if votes[j] is not None)
            hits = sum(m for m, (votes, _) in zip(mass, patterns) if votes[j] == vote)
            return (hits + Q.ACCURACY * pseudo) / (cast + pseudo)

        rest = [n - s for s, (_, n) in zip(shares, patterns)]
        prior = (sum(shares) + Q.PRIOR * pseudo) / (total + pseudo)
        good, bad = [right(j, 1, shares) for j in range(rules)], [right(j, 0, rest) for j in range(rules)]
    return prior, good, bad


def test_estimation(spark):
    patterns = [((1, 1, None), 50), ((1, 0, 0), 20), ((0, None, 0), 9), ((1, 1, 1), 3), ((None, None, None), 4), ((0, 1, None), 2)]
    rows = [votes for votes, n in patterns for _ in range(n)]
    voted = spark.createDataFrame(rows, "a int, b int, c int")
    prior, good, bad = plain_em(patterns, 3)
    found = Q.accuracies(voted, ["a", "b", "c"])
    assert found.prior == pytest.approx(prior, abs=1e-9)
    assert found.on_good == pytest.approx(good, abs=1e-9) and found.on_bad == pytest.approx(bad, abs=1e-9)


def test_good_stays_and_junk_goes(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    good = [". ".join(" ".join(word() for _ in range(12)) for _ in range(6)) + "." for _ in range(120)]
    junk = [" ".join(word() + "$$$" for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(good + junk)] + [(1000, good[0]), (1000, None), (1001, "too short"), (1002, "a b c d e f g h " * 9)]
    found = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r.doc_id: r.kept for r in found if r.doc_id < 1000}
    assert all(kept[i] for i in range(120)) and not any(kept[i] for i in range(120, 132))
    assert sorted(r.kept for r in found if r.doc_id == 1000) == [False, True]
    assert {r.doc_id: r.base_failed for r in found if r.doc_id > 1000} == {1001: True, 1002: True}


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).where(F.lit(True)).collect() == []
