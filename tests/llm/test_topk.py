"""Exact top-k against all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talkloom.llm import topk as K


def plain(rows, k):
    def weights(v):
        return [math.floor(1024 * x) for x in v]

    good = [(i, weights(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in good:
        if i % 10 == 0 and v not in queries.setdefault(i, []):
            queries[i].append(v)
    for q, vs in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for v in vs for i, w in good if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("candidates, queries, blocks", [(4096, 1024, 2), (7, 3, 1), (1, 1, 5)])
def test_against_all_scores(spark, monkeypatch, candidates, queries, blocks):
    monkeypatch.setattr(K, "CANDIDATES", candidates)
    monkeypatch.setattr(K, "QUERIES", queries)
    monkeypatch.setattr(K, "BLOCKS", blocks)
    rng = random.Random(8)
    rows = [(i, [float(rng.choice([0, 0, 0.5, -0.25, rng.uniform(-1, 1)])) for _ in range(8)]) for i in range(60)]
    # Ties, repeated candidates, other lengths, and vectors that take no part.
    rows += [(61, rows[1][1]), (62, rows[1][1]), (63, rows[3][1]), (63, rows[3][1]), (64, []), (65, [0.0] * 8), (66, [1.0]), (70, [2.0] * 12), (130, [0.5] * 8), (130, [0.25] * 8), (130, [0.5] * 8),
             (None, [1.0] * 8), (80, None), (90, [float("nan")] * 8), (100, [float("inf")] * 8), (110, [None] * 8)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    found = K.search(vectors, F.col("vec_id") % 10 == 0, k=5)
    assert sorted(map(tuple, found.collect())) == plain(rows, 5)


def test_few_candidates_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0]), (1, [0.5])], schema)
    assert [tuple(r) for r in K.search(two, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 512)]
    assert K.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []
    assert K.search(two, F.col("vec_id") > 5).collect() == []
