"""Large groups of sets that share keys, but do not link."""

import random
from itertools import combinations

import pytest
from test_jaccard import corpus, found, plain

from talkloom.llm import jaccard as J


def test_leaves_of_large_groups_are_not_paired_one_by_one(spark):
    """Pairs do not grow with the square of a group's size, and all classes that share a group still meet."""
    rng = random.Random(3)
    groups = [{*range(300)}, {*range(250, 420)}, {*range(100, 500, 7)}, *[{*rng.sample(range(600), rng.randrange(2, 6))} for _ in range(40)]]
    # Leaf 7 has several classes, leaf 500 more than a chunk; classes of leaves 20 to 29 are one connected part.
    classes = [(b"%d" % k, k, k, 50) for k in range(600)] + [(b"x%d" % k, 1000 + k, 7, 50) for k in range(5)] \
        + [(b"y%d" % k, 2000 + k, 500, 50) for k in range(J.CHUNK_SETS + 5)]
    part = {b"%d" % k for k in range(20, 30)}
    placed, pairs = J._unconnected(
        spark.createDataFrame(classes, "class binary, doc_id long, leaf long, n long"),
        spark.createDataFrame([(c, b"20") for c in part], "node binary, component binary"),
        spark.createDataFrame([(10**6 + g, leaf) for g, leaves in enumerate(groups) for leaf in leaves], "group long, leaf long"))
    rows = pairs.collect()
    under = {}
    for r in placed.collect():
        under.setdefault(r.leaf, set()).add(bytes(r["class"]))
    met = {frozenset((x, y)) for r in rows for x in under[r.a] for y in under[r.b]}
    for leaves in [*groups, {7}, {500}]:
        for x, y in combinations([c for c, _, leaf, _ in classes if leaf in leaves], 2):
            assert {x, y} <= part or frozenset((x, y)) in met
    assert len(rows) < 1000 and len({(r.a, r.b) for r in rows}) == len(rows)


@pytest.mark.parametrize("seed, sets", [(0, 64), (2, 2)])
def test_put_together_against_all_pairs(spark, seed, sets, monkeypatch):
    monkeypatch.setattr(J, "PAIRED", 1)
    monkeypatch.setattr(J, "CHUNK_SETS", sets)
    rows = corpus(seed)
    assert found(J.join(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_filter_of_few_texts_is_small(spark, monkeypatch):
    """It is a literal of the plan, which the driver holds and sends several times."""
    words, filtered = [], J.may_be_in
    monkeypatch.setattr(J, "may_be_in", lambda *a: words.append(a[3]) or filtered(*a))
    text = " ".join("w%d" % k for k in range(40))
    rows = [(1, text), (2, text + " more"), (3, "another text than these")]
    assert {r.doc_id: r.component_id for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3}
    assert words and max(words) <= 1 << 12
