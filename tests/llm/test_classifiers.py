"""Held-out results of the two classifiers, and their edges."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import language_id as I, queries, toxicity as T
from talkloom.llm.folds import fold

SF = "/root/testdata/sf0.01"
#: Has more than a few dozen toxic documents to learn from.
LARGER = "/root/testdata/sf0.1"


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    found = {r[0]: r[1] for r in rows.select("doc_id", fold("doc_id", 5)).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)} | {None: 1}


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    found = queries.op6_toxicity(spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in found if r.toxic], [r for r in found if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    order = [(r.score, s.score) for r in toxic for s in clean]
    assert sum((a > b) + (a == b) / 2 for a, b in order) >= 0.95 * len(order)
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)


def plain_words(text, known):
    """Words with the known subwords they hold, one by one."""
    spaced = [b" " + w + b" " for w in (text or "").lower().encode().translate(T._LETTERS).split()]
    found = []
    for word in spaced:
        held = {word[i:i + n] for n in range(T.SHORTEST, T.LONGEST + 1) for i in range(len(word) - n + 1)}
        numbers = sorted(k for k, key in enumerate(known.keys.tolist()) if key in {int.from_bytes(h, "big") for h in held})
        if numbers:
            found.append(numbers)
    return found


@pytest.mark.parametrize("piece", [1 << 20, 60, 9, 1])
def test_words_of_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    rng = random.Random(piece)
    grams = [b" abc", b"abca", b"bcab ", b" abcabca", b"cabcabca", b"aa a", b" aaa ", "é日".encode() + b" "]
    known = T.Subwords(np.array([int.from_bytes(g, "big") for g in grams]))
    texts = [None, "", "   ", "ABC abca", "\u0000abca", "aaa" * 30, "xé日 abc1bcab", *[
        "".join(rng.choice("abc  é") for _ in range(rng.randrange(200))) for _ in range(30)]]
    found = T.words_of(texts, known)
    ends = np.cumsum(found.size)
    rows = [(t, found.subwords[e - s:e].tolist()) for t, s, e in zip(found.text.tolist(), found.size.tolist(), ends.tolist())]
    expected = []
    for t, text in enumerate(texts):
        words = plain_words(text, known)
        expected += [(t, held) for k, held in enumerate(words) if held not in words[:k]]
    assert rows == expected


def plain_risk(w, b, kinds, prior):
    at, toxic_called_clean, toxic_called_toxic, any_called_toxic = 0, 0.0, 0.0, 0.0
    for size, p, u in zip(kinds.size, kinds.positive, kinds.unlabelled):
        z = b + sum(w[k] for k in kinds.subwords[at:at + size])
        at += size
        toxic_called_clean += p * math.log(1 + math.exp(-z))
        toxic_called_toxic += p * math.log(1 + math.exp(z))
        any_called_toxic += u * math.log(1 + math.exp(z))
    return prior * toxic_called_clean, any_called_toxic - prior * toxic_called_toxic


def some_kinds(seed, unlabelled):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 5, 12)
    return T.Kinds(size, rng.integers(0, 6, size.sum()), rng.random(12), rng.random(12) * unlabelled)


@pytest.mark.parametrize("unlabelled", [1.0, 0.05])
def test_risk_and_its_gradient(unlabelled):
    for seed in range(20):
        kinds, prior = some_kinds(seed, unlabelled), 0.3
        rng = np.random.default_rng(seed)
        w, b = rng.normal(size=6), rng.normal()
        total, slope, slope_b = T.risk(w, b, kinds, prior)
        first, second = plain_risk(w, b, kinds, prior)
        assert total == pytest.approx(first + max(0.0, second))
        # Where the second part is below zero, it is brought back up.
        followed = (lambda r: r[0] + r[1]) if second >= 0 else (lambda r: -r[1])
        for k in range(6):
            step = np.eye(6)[k] * 1e-6
            numeric = (followed(plain_risk(w + step, b, kinds, prior)) - followed(plain_risk(w - step, b, kinds, prior))) / 2e-6
            assert slope[k] == pytest.approx(numeric, abs=1e-6)
        numeric = (followed(plain_risk(w, b + 1e-6, kinds, prior)) - followed(plain_risk(w, b - 1e-6, kinds, prior))) / 2e-6
        assert slope_b == pytest.approx(numeric, abs=1e-6)


def test_threshold_of_least_risk():
    rng = np.random.default_rng(3)
    for _ in range(50):
        positive, unlabelled = rng.normal(2, 1, 40).round(1), rng.normal(0, 1, 200).round(1)
        at, least = T.choose_threshold(positive, unlabelled, 0.1)
        plain = lambda t: 0.1 * (positive <= t).mean() + max(0.0, (unlabelled > t).mean() - 0.1 * (positive > t).mean())
        tried = np.arange(-5, 7, 0.05) + 0.025
        assert least == pytest.approx(min(map(plain, tried))) and plain(at) <= least + math.sqrt(0.1 * 0.9 / 200) / 4 + 1e-9


def planted(rng, lang, words):
    """A long clean text with some words put in."""
    syllables = {"en": ["the", "ing", "and", "er"], "de": ["ung", "sch", "ein", "ö"], "fr": ["eau", "ré", "tion", "è"]}[lang]
    text = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    for word in words:
        text.insert(rng.randrange(len(text)), word)
    return " ".join(text)


STEMS = {"en": ["idiot", "clown", "moron"], "de": ["lowei", "lostra"], "fr": ["vequ", "veju"]}
ENDINGS = {"en": [""], "de": ["", "an", "ich", "heit", "ö", "ern"], "fr": ["", "ais", "ée", "eur", "ment"]}


def test_planted_words_and_unseen_forms(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(3000):
        lang = rng.choice(["en", "de", "fr"])
        toxic = i % 10 == 0
        # Toxic documents hold several words, of which no form of the last ending.
        words = [rng.choice(STEMS[lang]) + rng.choice(ENDINGS[lang][:max(1, len(ENDINGS[lang]) - 1)]) for _ in range(rng.randrange(2, 6))]
        rows.append((i, planted(rng, lang, words if toxic else [])))
        if i % 3 < 2:
            labels.append((i, int(toxic)))
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = T.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for lang in STEMS:
        clean = model.scores([planted(rng, lang, []) for _ in range(100)])
        assert (clean >= 0.5).mean() <= 0.03
        for number in (1, 2, 3):
            known = [planted(rng, lang, [rng.choice(STEMS[lang]) + ENDINGS[lang][0] for _ in range(number)]) for _ in range(60)]
            assert (model.scores(known) >= 0.5).mean() >= 0.95
            unseen = [planted(rng, lang, [rng.choice(STEMS[lang]) + ENDINGS[lang][-1] for _ in range(number)]) for _ in range(60)]
            assert (model.scores(unseen) >= 0.5).mean() >= 0.95


def test_toxicity_edges(spark):
    texts = [None, "", "an IDIOT!", "clean words", "idiot " * 100_000, "\u0000", "clean words"]
    documents = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "idiot", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, None), (4, 0), (4, 1), (None, 1)], "doc_id long, toxic int")
    many = documents.unionByName(spark.createDataFrame([(10 + i, "you idiot" if i % 3 else "fine", "x") for i in range(90)], documents.schema))
    more = labels.unionByName(spark.createDataFrame([(10 + i, int(i % 3 > 0)) for i in range(90)], labels.schema))
    for model in (T.fit(documents, labels), T.fit(documents, labels.where("toxic = 0")), T.fit(documents.limit(0), labels), T.fit(many, more)):
        found = T.score(documents, model).collect()
        assert len(found) == len(texts) + 1 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (2, 4, None)} == {max(r.score for r in found)}
    assert T.score(documents.limit(0), model).collect() == []


def test_held_out_language(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op10_language_id(spark, SF).join(documents, "doc_id").where("held_out").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def plain_bins(text):
    data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
    found = []
    for n in I.LENGTHS:
        for i in range(len(data) - n + 1):
            key = n
            for b in data[i:i + n]:
                key = (key << 8 | b) & (1 << 64) - 1
            found.append((key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - I.BITS))
    return sorted(found)


@pytest.mark.parametrize("piece", [1 << 20, 5, 1])
def test_bins_of_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(I, "PIECE", piece)
    for text in ("", "a", "Ab1 é日", "some longer text 12"):
        assert sorted(b for p in I.bins(text) for b in p.tolist()) == plain_bins(text)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "", None),
            (6, "the dog " * 100_000, "en"), (7, "the dog", None), (None, "und der Hund", "de"), (2, "der Hund und die Katze", "de")]
    documents = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = I.fit(documents)
    found = [(r.doc_id, r.lang_pred, r.score) for r in I.predict(documents, model).select("doc_id", "lang_pred", "score").collect()]
    assert len(found) == len(rows)
    assert {i: lang for i, lang, _ in found} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en", 7: "en", None: "de"}
    assert all(0 <= score <= 1 for *_, score in found)
    nothing = I.fit(documents.where(F.lit(False)))
    assert {r.lang_pred for r in I.predict(documents, nothing).collect()} == {"und"}
    assert I.predict(documents.limit(0), model).collect() == []
