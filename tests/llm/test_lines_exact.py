"""Short lines by equality, and versions of one id, against comparing every line with all earlier ones."""

import random

import pytest

from talkloom.llm import lines as L, stages as S
from test_lines import distance_at_most_one


def plain(rows, exact):
    """Every row loses its own lines that equal an earlier one, or have an earlier one within one edit."""
    seen = [((doc, n), line.strip(" \t\r\f\x0b")) for doc, text in rows if doc is not None and text is not None
            for n, line in enumerate(text.split("\n"))]

    def goes(doc, n, bare):
        return any(at < (doc, n) and (len(bare) >= exact and bare == other or min(len(bare), len(other)) >= L.MIN_CHARS and distance_at_most_one(bare, other))
                   for at, other in firsts if at < (doc, n))

    least = {}
    for at, bare in seen:
        least[bare] = min(at, least.get(bare, at))
    firsts = [(at, bare) for bare, at in least.items()]
    # A line repeats an earlier one, or is the same as a line that does.
    near = {bare for at, bare in firsts if goes(*at, bare)}
    out = []
    for doc, text in rows:
        if doc is not None and text is not None:
            text = "\n".join(x for n, x in enumerate(text.split("\n")) for b in [x.strip(" \t\r\f\x0b")]
                             if not (b in near or len(b) >= exact and least[b] != (doc, n)))
        out.append((str(doc), text))
    return sorted(out, key=str)


def found(df):
    return sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["short", "*", "All rights reserved", "a line of twenty and more", "a line of twenty and mor", "a line of twenty and some more letters", "", "  "]
    pool += ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30))) for _ in range(10)]
    rows = [(rng.randrange(25), "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 6)))) for _ in range(45)]
    return rows + [rows[0], (None, "short"), (30, None), (31, "")]


@pytest.mark.parametrize(("seed", "exact"), [(0, 1), (1, 20), (2, 7)])
def test_short_lines_and_versions(spark, seed, exact):
    rows = corpus(seed)
    assert found(L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), exact_chars=exact)) == plain(rows, exact)


def test_the_stage_empties_exact_copies_with_short_lines(spark):
    rows = [(1, "Heading\nAll rights reserved\na text with some more words"), (2, "Heading\nAll rights reserved\na text with some more words"), (3, "Heading\nown")]
    left = S.repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert found(left) == [("1", rows[0][1]), ("3", "own")]
