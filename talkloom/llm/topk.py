"""Exact top-k search by inner product, term at a time, over blocks of vectors.

A vector is a sparse row: its terms are the positions of its non-zero components.
Candidates are kept as postings, one list of (row, weight) per term. A query
scatters, for each of its terms, the weighted posting list into a dense array with
one score per candidate of the block, then the best k are taken by partition
selection. Every query meets every candidate, in blocks: queries and candidates are
cut into blocks of bounded size, and each pair of blocks is scored in one task,
which carries only the best k of each query along. A last window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from talkloom.session import materialise

#: Vectors of a block.
CANDIDATES = 4_096
QUERIES = 1_024
#: Blocks of candidates that a cell of the grid has on average.
BLOCKS = 2

PACKED = "ids binary, sizes binary, terms binary, weights binary"


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({
        "ids": [rows["id"].to_numpy(np.int64).tobytes()],
        "sizes": [rows["terms"].map(len).to_numpy(np.int64).tobytes()],
        "terms": [np.concatenate(rows["terms"].tolist()).astype(np.int32).tobytes()],
        "weights": [np.concatenate(rows["weights"].tolist()).astype(np.int64).tobytes()],
    })


def _pack_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return _packed(rows).assign(block=key[0])


def _pack(block: int):
    """Puts the vectors (id, terms, weights) of each task into blocks of at most ``block`` rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True)
            while len(held) >= block:
                yield _packed(held.iloc[:block])
                held = held.iloc[block:]
        if len(held):
            yield _packed(held)

    return pack


def _unpack(ids: bytes, sizes: bytes, terms: bytes, weights: bytes):
    return (np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64),
            np.frombuffer(terms, np.int32), np.frombuffer(weights, np.int64))


class Postings:
    """Posting lists of a block of candidates: term -> rows and their weights."""

    def __init__(self, ids, sizes, terms, weights) -> None:
        order = np.argsort(terms, kind="stable")
        self.ids = ids
        self.rows = np.repeat(np.arange(len(ids)), sizes)[order]
        self.weights = weights[order]
        found, first = np.unique(terms[order], return_index=True)
        self.lists = dict(zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(terms)])))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        score = np.zeros(len(self.ids), dtype=np.int64)
        for term, weight in zip(terms.tolist(), weights.tolist()):
            if term in self.lists:
                start, end = self.lists[term]
                # A row occurs once in a posting list, so the scattered sum needs no ufunc.at.
                score[self.rows[start:end]] += weight * self.weights[start:end]
        return score


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    places = np.arange(len(scores))
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= limit)
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def sparse_rows(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """id, terms, weights: floor(scale * component) of each vector, without the zeros.

    Left out are rows without id or vector, and vectors with a null or non-finite component.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    values = F.col(embedding).cast("array<double>")
    whole = vectors.select(F.col(vec_id).alias("id"), values.alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))
    weighted = F.transform("vector", lambda x, i: F.struct(i.alias("term"), F.floor(x * scale).cast("long").alias("weight")))
    kept = whole.select("id", F.filter(weighted, lambda t: t["weight"] != 0).alias("kept"))
    return kept.select("id", F.col("kept.term").alias("terms"), F.col("kept.weight").alias("weights"))


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
           scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, all if there are fewer.

    ``is_query`` is a condition on the columns of ``vectors``; candidates are all rows
    but those with the query's own id. Vectors of different length are compared over
    their common positions. Repeated rows stay: a candidate that occurs twice takes two
    ranks, and a query that occurs twice is answered once. Different vectors under one
    query's id are asked together: the k best of all their scores are its answer. Scores are exact while they
    fit a signed 64-bit integer.
    """
    rows = sparse_rows(vectors, vec_id, embedding, scale)
    candidates = materialise(rows.mapInPandas(_pack(CANDIDATES), PACKED), "search_candidates")
    asked = materialise(
        sparse_rows(vectors.where(is_query), vec_id, embedding, scale).distinct(), "search_queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    groups = max(1, -(-candidates.count() // BLOCKS))
    queries = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).applyInPandas(
        _pack_block, "block long, " + PACKED)

    # A grid: each cell has one block of queries and a few blocks of candidates.
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    of_cell = candidates.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn("block", numbers(blocks))
    to_cell = queries.select(
        "block", numbers(groups).alias("part"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "sizes", "terms", "weights")])
    pairs = of_cell.join(to_cell, ["block", "part"])

    schema = "query_id long, vec_id long, score long"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, kept = None, {}

        def flush() -> pd.DataFrame:
            return pd.DataFrame(
                [(q, i, s) for q, (ids, scores) in kept.items() for i, s in zip(ids.tolist(), scores.tolist())],
                columns=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.block != block:
                    if kept:
                        yield flush()
                    block, kept = row.block, {}
                postings = Postings(*_unpack(row.ids, row.sizes, row.terms, row.weights))
                ids, sizes, terms, weights = _unpack(row.q_ids, row.q_sizes, row.q_terms, row.q_weights)
                ends = np.cumsum(sizes)
                for query, start, end in zip(ids.tolist(), (ends - sizes).tolist(), ends.tolist()):
                    scores = postings.scores(terms[start:end], weights[start:end])
                    others = postings.ids != query
                    found, scores = postings.ids[others], scores[others]
                    if query in kept:
                        found = np.concatenate([kept[query][0], found])
                        scores = np.concatenate([kept[query][1], scores])
                    places = best(found, scores, k)
                    kept[query] = found[places], scores[places]
        if kept:
            yield flush()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = pairs.mapInPandas(score, schema).withColumn("rank", F.row_number().over(order))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
