"""Raking against plain loops, and the mix that sampling gives."""

import pytest

from talkloom.llm import mixing as M


def corpus(spark, n=3000):
    rows = [(i, f"s{i % 7 % 3}", ["en", "de", None][i % 11 % 3], "word " * (i % 13) + ("Copyright" if i % 5 == 0 else ""), "x") for i in range(n)]
    rows += [(1, "s0", "en", "a b", "x"), (1, "s0", "en", "a b", "x"), (None, None, None, None, None), (n, "s9", "fr", "", "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, weight string"), rows


def plain_rake(cells, rounds):
    weight = dict(cells)
    total = sum(cells.values())
    targets = []
    for d in range(3):
        share = {}
        for cell, tokens in cells.items():
            share[cell[d]] = share.get(cell[d], 0) + tokens
        share = {v: t ** M.TEMPERATURE for v, t in share.items()}
        targets.append({v: s / sum(share.values()) for v, s in share.items()})
    for _ in range(rounds):
        for d, target in enumerate(targets):
            now = {}
            for cell, w in weight.items():
                now[cell[d]] = now.get(cell[d], 0) + w
            weight = {c: w * target[c[d]] * total / now[c[d]] if now[c[d]] else 0.0 for c, w in weight.items()}
    return weight


def test_rates_and_every_row_back(spark):
    documents, rows = corpus(spark)
    described = M.describe(documents)
    found = M.mix(described).collect()
    assert len(found) == len(rows)
    cells = {}
    for r in found:
        cell = (r.source, r.lang, r.topic)
        cells[cell] = cells.get(cell, 0) + r.tokens
    weight = plain_rake(cells, M.ROUNDS)
    rate = {c: weight[c] / t for c, t in cells.items() if t}
    highest = max(rate.values())
    for r in found:
        cell = (r.source, r.lang, r.topic)
        assert r.probability == pytest.approx(rate[cell] / highest if cell in rate else 1.0, rel=1e-9)
        assert r.weight == pytest.approx(r.tokens * rate.get(cell, 0.0), rel=1e-9)
    assert {r.sampled for r in found if r.doc_id == 1 and r.tokens == 2} in ({True}, {False})


def test_sample_has_the_target_shares(spark):
    documents, _ = corpus(spark, 20_000)
    described = M.describe(documents)
    target = spark.createDataFrame([("s0", 0.2), ("s1", 0.3), ("s2", 0.5)], "value string, share double")
    found = M.mix(described, ["source"], {"source": target}).where("sampled").groupBy("source").sum("tokens").collect()
    tokens = {r[0]: r[1] for r in found}
    total = sum(tokens.values())
    for source, share in (("s0", 0.2), ("s1", 0.3), ("s2", 0.5)):
        assert tokens[source] / total == pytest.approx(share, abs=0.02)


def test_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert M.mix(M.describe(documents)).collect() == []
