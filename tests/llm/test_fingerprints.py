"""Fingerprints against a plain version, and their likeness on edited texts."""

import hashlib
import random

import pytest

from talkloom.llm import fingerprints as P, queries


def plain_levels(data):
    found = []
    for i in range(len(data)):
        h = 0
        for k in range(P.WINDOW):
            at = i - P.WINDOW + 1 + k
            h = (h * 0x5BD1E995 + (data[at] if at >= 0 else 0)) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 13
        found.append(len(bin(h)) - len(bin(h).rstrip("1")))
    return found


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


@pytest.mark.parametrize("piece", [1 << 20, 50, 7, 1])
def test_levels(monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    for data in (b"", b"a", "Prose, é 日 and more of it. ".encode() * 9, bytes(100)):
        assert P.levels(data).tolist() == plain_levels(data)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(500):
        a, b = [[rng.choice("abcd") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130]))] for _ in "ab"]
        if rng.random() < 0.5:
            b = a[:rng.randrange(len(a) + 1)] + b[:5] + a[rng.randrange(len(a) + 1):]
        assert P.edit_distance(a, b) == plain_distance(a, b)


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(1, 9))) for _ in range(words))


def test_pieces_cover_the_whole_text():
    rng = random.Random(4)
    for words in (0, 1, 5, 40, 300, 5000, 40_000):
        text = prose(rng, words)
        size, small, large = P.fingerprint(text).split(":")
        assert len(small) <= 2 * P.MOST and len(large) <= len(small) and int(size) >= 4
        if words >= 300:
            assert len(small) > P.MOST // 3
            # Any change shows, wherever it is.
            for at in (0, len(text) // 2, len(text) - 1):
                assert P.fingerprint(text[:at] + "#" + text[at + 1:]) != P.fingerprint(text)
    for text in ("a" * 100_000, "ab" * 50_000, "\u0000" * 999):
        assert len(P.fingerprint(text)) <= 4 * P.MOST + 20


def test_likeness():
    rng = random.Random(5)
    for words in (60, 400, 3000):
        text, other = prose(rng, words), prose(rng, words)
        near = P.likeness(P.fingerprint(text), P.fingerprint(text.replace(text[words], "#", 1)))
        half = P.likeness(P.fingerprint(text), P.fingerprint(P.spliced(text, other)))
        far = P.likeness(P.fingerprint(text), P.fingerprint(other))
        assert near > 0.8 and 0.2 < half < 0.8 and far < 0.2
    assert P.likeness(P.fingerprint(""), P.fingerprint(None)) == 1


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        marks = [P.fingerprint(t) for t in (text, edited, following)]
        found.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1],
                      P.likeness(*marks[:2]), P.likeness(marks[0], marks[2])))
    return sorted(found, key=str)


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_query_against_plain_rows(spark, tmp_path, partitions):
    rng = random.Random(6)
    rows = [(i * 3, prose(rng, rng.randrange(0, 120))) for i in range(60)]
    rows += [(1, None), (2, ""), (4, "é"), (5, "日本"), (7, "x" * 300_000), (None, "no id"), (-9, "below zero"), (8, rows[20][1]), (10, rows[20][1])]
    documents = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "doc_id long, text string, hash string, place string, part int")
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = queries.op11_fingerprints(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_repeated_ids_and_small_tables(spark):
    rows = [(1, "same id, one text")] * 3 + [(1, "same id, another text"), (None, "none"), (None, None)]
    found = P.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in found) == sorted((d or 0, len(t or "")) for d, t in rows)
    # Two of the three equal rows are followed by their equal.
    assert sum(r.near_next == 1 for r in found) >= 2
    alone = P.with_next(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1
    assert P.with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []
