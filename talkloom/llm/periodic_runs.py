"""Periodic runs in texts: stretches of words that repeat with a period.

A run of period q and at least 3 q words holds a multiple of q, i, so that the words from
i on equal those from i + q on; the multiples of all periods are n (1 + 1/2 + 1/3 + ...)
places. At each whose word equals the one q further, the grammar of
:mod:`talkloom.llm.recompression` tells how far the two go on alike to the right and to
the left, which gives the whole run. Texts are put into one sequence with marks between them, up
to ``WORDS`` words at a time; a longer text is alone. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talkloom.llm.recompression import Grammar

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of texts that share one grammar.
WORDS = 200_000
#: Places looked at at once.
PLACES = 1 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text in UTF-8."""
    # These six are what bytes.split takes for white space.
    return (text or "").encode("utf-8", "replace").split()


def stutter(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in one of ten documents (by id) with a tail that repeats a stretch of them; without id as they are."""
    if doc_id is None or not words:
        return words
    check = zlib.crc32(str(doc_id).encode())
    if check % 10:
        return words
    g, n = check // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _places(lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q: all multiples of q for each q that a text may hold LEAST_PERIODS of.

    ``lengths`` are those of the texts in the sequence, which come from the longest to the shortest.
    """
    lengths = np.array(lengths)
    ends = np.cumsum(lengths + 1)
    # Up to where the sequence has texts of at least so many words as periods of q need.
    q = np.arange(1, int(lengths[0]) // LEAST_PERIODS + 1)
    texts = np.searchsorted(-lengths, -np.maximum(LEAST_PERIODS * q, LEAST_WORDS), side="right")
    counts = np.where(texts > 0, (ends[np.maximum(texts, 1) - 1] - q) // q, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    start = 0
    while start < len(q):
        end = max(start + 1, int(np.searchsorted(before, before[start] + PLACES, side="right")) - 1)
        periods = np.repeat(q[start:end], counts[start:end])
        nth = np.arange(1, len(periods) + 1) - np.repeat(before[start:end] - before[start], counts[start:end])
        yield nth * periods, periods
        start = end


def runs_of(texts: list[np.ndarray], distinct: int) -> list[list[tuple[int, int, int]]]:
    """start, length and period of the runs of each text, by start and period; words are numbers below ``distinct``."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((k for k, t in enumerate(texts) if len(t) >= LEAST_WORDS), key=lambda k: -len(texts[k]))
    if not order:
        return found
    lengths = [len(texts[k]) for k in order]
    parts = [np.array([distinct])]
    for nth, k in enumerate(order):
        parts += [texts[k], np.array([distinct + nth + 1])]
    sequence = np.concatenate(parts)
    # Sequence index of each text's first word.
    firsts = np.cumsum([1] + [n + 1 for n in lengths[:-1]])
    text_at = np.repeat(np.arange(len(order) + 1), [1] + [n + 1 for n in lengths])
    grammar = Grammar(sequence, distinct)
    seen: dict[tuple[int, int], int] = {}
    for i, q in _places(lengths):
        alike = (sequence[i] == sequence[i + q]) & (text_at[i] == text_at[i + q])
        i, q = i[alike], q[alike]
        right = grammar.extensions(i, i + q)
        # A run goes on from its first multiple of q for so many words at least.
        enough = right >= np.maximum(q, LEAST_WORDS + 1 - 2 * q)
        i, q, right = i[enough], q[enough], right[enough]
        left = grammar.extensions(i, i + q, forward=False)
        length = left - 1 + q + right
        run = length >= np.maximum(LEAST_PERIODS * q, LEAST_WORDS)
        if run.any():
            for start, size, period in np.unique(np.stack([i - left + 1, length, q])[:, run], axis=1).T.tolist():
                # A multiple of the period spans the same words, as three of it fit in.
                seen[start, size] = min(period, seen.get((start, size), period))
    for (start, size), period in sorted(seen.items(), key=lambda r: (r[0][0], r[1])):
        nth = text_at[start] - 1
        found[order[nth]].append((int(start - firsts[nth]), size, period))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def _numbered(texts: list[list[bytes]]) -> tuple[list[np.ndarray], int]:
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    coded = [np.array([number(w, len(numbers)) for w in words], dtype=np.int64) for words in texts]
    return coded, len(numbers)


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", stuttering: bool = False) -> DataFrame:
    """doc_id, n_words, runs and collapsed (the words without what runs repeat) of every row.

    A run is a longest stretch of words with smallest period q that has LEAST_WORDS words and
    LEAST_PERIODS periods or more. Null and empty texts have no words, no runs and an empty
    collapsed text; null ids stay; repeated rows are searched each. With ``stuttering`` each text is
    first changed by :func:`stutter`. Further columns of the input play no part.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            runs = runs_of(*_numbered([words for _, words in held]))
            row = lambda r: dict(zip(("start", "length", "period"), r))
            return pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in held], pa.int64()), pa.array([len(words) for _, words in held], pa.int64()),
                pa.array([[row(r) for r in rs] for rs in runs],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array([collapse(words, rs).decode("utf-8") for (_, words), rs in zip(held, runs)], pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            for doc, value in zip(batch.column("doc_id"), batch.column("text")):
                doc, words = doc.as_py(), words_of(value.as_py())
                held.append((doc, stutter(words, doc) if stuttering else words))
                size += len(words) + 1
                if size >= WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    named = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(search, SCHEMA)


def strongest(runs: str = "runs"):
    """The run with most periods (length over period), of equal ones the first by start, then period; null without a run."""
    # Fractions are compared by cross-multiplication, which is exact.
    better = lambda best, r: (
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]))
    empty = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, empty, lambda best, r: F.when(better(best, r), r).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and checksums of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", strongest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000L div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
