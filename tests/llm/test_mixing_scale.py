"""The sampling scale from a corpus target, and raking to a bound."""

import pytest

from talkloom.llm import mixing as M

DESCRIBED = "doc_id long, source string, lang string, topic string, tokens long"


def corpus(stray):
    rows = [(i, f"s{i % 5}", ["en", "de", "es"][i % 7 % 3], "prose", 10 + i % 13 * (i % 5)) for i in range(2000)]
    return rows + [(5000, "s1", *s, 5) if len(s) == 2 else (5000, *s, 5) for s in stray]


@pytest.mark.parametrize("stray", [[], [("fr", "contact")], [(M.NONE, M.NONE, "prose")]])
def test_a_rare_cell_does_not_decide_what_is_left(spark, stray):
    rows = corpus(stray)
    found = M.mix(spark.createDataFrame(rows, DESCRIBED), keep=0.8, bound=0.001).collect()
    assert len(found) == len(rows)
    assert sum(r.tokens * r.probability for r in found) == pytest.approx(0.8 * sum(r.tokens for r in found), rel=1e-9)
    scale = max(r.probability * r.tokens / r.weight for r in found)
    for r in found:
        assert r.probability == pytest.approx(min(1.0, scale * r.weight / r.tokens), rel=1e-9)


def test_rounds_go_on_until_the_margins_agree(spark):
    # Nearly separate blocks, which ten rounds leave further off than the bound.
    cells = spark.createDataFrame([("a", "x", 1000), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1000)], "source string, lang string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "value string, share double"),
               "lang": spark.createDataFrame([("x", 0.4), ("y", 0.6)], "value string, share double")}
    worst = lambda raked: max(abs(r.error) for r in M.margins(raked, targets, raked["weight"]).collect())
    assert worst(M.rake(cells, targets)) > 0.001
    assert worst(M.rake(cells, targets, bound=0.001)) <= 0.001


def test_all_is_kept_where_all_is_wanted(spark):
    found = M.mix(spark.createDataFrame(corpus([]), DESCRIBED), keep=1.0, bound=0.01).where("NOT sampled").count()
    assert found == 0
