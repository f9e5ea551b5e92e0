"""Stages of the corpus pipeline against plain versions, and run() against its stages."""

import random
import re

import pytest

import corpus_pipeline
from talkloom.llm import jaccard as J, stages as S
from talkloom.session import materialise


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) > width else frozenset([tuple(w)] if w else [])


def links(sets, per_cent):
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= per_cent * len(a | b)}


def firsts(rows, width, per_cent):
    """The rows that near_duplicates keeps: one of each group, that with the smallest id."""
    group = list(range(len(rows)))
    for i, j in links([shingles(t, width) if d is not None else None for d, t in rows], per_cent):
        group = [group[j] if g == group[i] else g for g in group]
    kept = []
    for (d, t), g in zip(rows, group):
        if d is None or d == min(e for (e, _), h in zip(rows, group) if h == g):
            if d is None or (d, t) not in kept:
                kept.append((d, t))
    return sorted(kept, key=str)


def corpus(seed):
    """Documents with some word exchanged, taken out or put in, so that many lie between 0.8 of 5 words and 0.9 of 3."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    rows = [(None, "no id"), (None, "no id"), (900, None), (901, ""), (902, "one"), (903, "One"), (904, "a b c d e"), (905, "A b c d e"), (906, "a b c d f")]
    for g in range(14):
        base = [word() for _ in range(rng.randrange(8, 150))]
        for _ in range(rng.randrange(1, 8)):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                at = rng.randrange(len(text))
                text[at:at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
            rows.append((1000 - len(rows), " ".join(text)))
    return rows + [rows[20], (rows[21][0], "a text of its own under an id that is there twice")]


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_of_five_words_and_four_fifths(spark, seed):
    rows = corpus(seed)
    between = links([shingles(t, 5) for _, t in rows], 80) - links([shingles(t, 3) for _, t in rows], 90)
    assert between
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    found = S.near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == firsts(rows, 5, 80)


@pytest.mark.parametrize(("width", "per_cent"), [(1, 70), (2, 75), (5, 80), (3, 99)])
def test_other_widths_and_thresholds(spark, width, per_cent):
    rows = [r for r in corpus(7) if r[0] is not None]
    found = J.join(spark.createDataFrame(rows, "doc_id long, text string"), width=width, per_cent=per_cent).collect()
    sets = [shingles(t, width) for _, t in rows]
    group = [d for d, _ in rows]
    for _ in rows:
        for i, j in links(sets, per_cent):
            group[i] = group[j] = min(group[i], group[j])
    # Rows of the same id count as one document.
    first = lambda rs: {(d, n): min(c for e, m, c in rs if (e, m) == (d, n)) for d, n, _ in rs}
    plain = [(d, len(s), g) for (d, _), s, g in zip(rows, sets, group)]
    assert first([(r.doc_id, r.n_shingles, r.component_id) for r in found]) == first(plain) and len(found) == len(plain)


def test_thresholds_without_a_guarantee_are_refused(spark):
    for per_cent in (69, 100):
        with pytest.raises(ValueError):
            J.join(spark.createDataFrame([], "doc_id long, text string"), per_cent=per_cent)


def test_run_is_its_stages_one_after_the_other(spark, tmp_path):
    rng = random.Random(3)
    rows = [(d, t, "en", f"s{i % 2}", 0) for i, (d, t) in enumerate(corpus(3))]
    rows += [(2000 + i, "\n".join("%s line %d of a text" % (rng.choice("abcde") * 9, rng.randrange(9)) for _ in range(4)), "de", "s1", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 - i, 1, int(i % 9 == 0)) for i in range(9, 60)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    found = sorted(((r.doc_id, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    by = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    left = materialise(S.repeated_lines(spark, materialise(S.toxic(spark, docs, str(tmp_path)), "clean"), ""), "left")
    near = materialise(S.near_duplicates(spark, left, ""), "near")
    assert by(near) == firsts([(r.doc_id, r.text) for r in left.collect()], 5, 80)
    assert found and found == [(d, t or "") for d, t in by(S.mix(spark, near, ""))]
