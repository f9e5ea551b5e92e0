"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, ASCII characters other than letters become spaces, and all
byte sequences of the lengths ``LENGTHS`` in its UTF-8 form are hashed to
``2**BITS`` bins. Tasks count the bins of the training texts by language; Spark adds
the counts up. The log-probability matrix has one row per bin and one column per
language, so its size depends on the languages alone. Texts are scored against it
bin by bin, a piece of bounded length at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LENGTHS = (3, 4)
BITS = 15
PIECE = 1 << 20
SMOOTHING = 0.5
UNKNOWN = "und"

_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def bins(text: str) -> Iterator[np.ndarray]:
    """The bin of every n-gram, in pieces of about PIECE bytes that together cover the whole text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", dtype=np.uint8)
    for start in range(0, len(data), PIECE):
        piece = data[start:start + PIECE + max(LENGTHS) - 1]
        whole, found = len(data[start:start + PIECE]), []
        for n in LENGTHS:
            count = min(whole, len(piece) - n + 1)
            if count <= 0:
                continue
            key = np.full(count, n, dtype=np.uint64)
            for j in range(n):
                key = (key << np.uint64(8)) | piece[j:j + count]
            found.append((key * _MIX) >> np.uint64(64 - BITS))
        if found:
            yield np.concatenate(found).astype(np.int64)


class Model(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray  # bin by language

    def predict(self, text: str | None) -> tuple[str, float]:
        """Most likely language, the smaller name on a tie, and its posterior probability."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        log = self.log_prior.copy()
        for piece in bins(text):
            counts = np.bincount(piece, minlength=1 << BITS)
            seen = np.flatnonzero(counts)
            log += counts[seen] @ self.log_likelihood[seen]
        best = int(np.argmax(log))
        return self.languages[best], float(1.0 / np.exp(log - log[best]).sum())


def _counts(texts: DataFrame) -> DataFrame:
    """lang, bin, n and docs: what each task has counted; bin -1 has the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                into = total.setdefault(lang, np.zeros((1 << BITS) + 1, dtype=np.int64))
                for piece in bins(text):
                    into[1:] += np.bincount(piece, minlength=1 << BITS)
                into[0] += 1
        for lang, counted in total.items():
            seen = np.flatnonzero(counted)
            yield pd.DataFrame({"lang": lang, "bin": (seen - 1).astype("int32"), "n": counted[seen]})

    return texts.mapInPandas(count, "lang string, bin int, n long")


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", training: Column | None = None) -> Model:
    """The model of all training rows with a text and a language.

    Rows where ``training`` is not true are left out. Without training rows every
    prediction is ``und``.
    """
    known = documents if training is None else documents.where(training)
    known = known.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    counted = _counts(known).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # One row per language with its counts; languages and bins are few.
    rows = sorted(counted.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).collect())
    languages = [r["lang"] for r in rows]
    tally = np.zeros((len(rows), (1 << BITS) + 1))
    for i, row in enumerate(rows):
        for b, n in row["bins"]:
            tally[i, b + 1] = n
    prior = np.log(tally[:, 0] / max(tally[:, 0].sum(), 1.0)) if rows else np.zeros(0)
    smoothed = tally[:, 1:] + SMOOTHING
    return Model(languages, prior, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T.copy())


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` (``und`` for null and texts without a letter) and ``score``."""
    matrix = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        found = [matrix.value.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    found = documents.withColumn("_language", language(F.col(text)))
    kept = [F.col(c) for c in documents.columns if c not in ("lang_pred", "score")]
    return found.select(*kept, "_language.lang_pred", "_language.score")
