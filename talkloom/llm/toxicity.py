"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are labels; all other text is unlabelled. The risk
estimator of a linear classifier takes the part of the unlabelled risk that the
toxic share (the class prior) accounts for out again, and never lets that
difference go below zero: otherwise the classifier would learn its few positives
by heart.

*What is classified.* The words of a document, each by its subwords: the strings of
``SHORTEST`` to ``LONGEST`` bytes within the lower-cased word, a space on either end included, so
that a form never seen is known by its stem. Each word is judged on its own, so that none hides behind others that
always come with it. A document is as toxic as its words that are toxic rather than not
come to; the many others of a long text take nothing away.

*Which subwords.* Those that ``LEAST_SHARE`` of the confirmed documents have, and that
make their document toxic with a probability of ``LEAST_PRECISION`` or more, which is the prior times
their share in confirmed over that in unlabelled documents. The words that hold such
subwords are counted in all training text.

*What is bounded.* Confirmed documents (``POSITIVES``) and those that choose subwords and
threshold (``UNLABELLED``), lowest id checksum first. Words count as one kind if they hold the same
subwords; of the kinds that no confirmed document has, about ``KINDS`` are fitted, weighted to stand for
all. Decay and threshold are those of least risk over a fifth of the sampled documents, of which
nothing else is learned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from talkloom.llm.arrays import distinct
from talkloom.session import materialise

POSITIVES = 20_000
UNLABELLED = 40_000
SHORTEST, LONGEST = 4, 8
#: Confirmed documents that must hold a subword: so many, and such a share of them.
LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.0025
LEAST_PRECISION = 0.3
#: Confirmed documents whose subwords a task counts.
TOGETHER = 2_000
KINDS = 200_000
DECAYS = (3e-3, 1e-3, 3e-4)
STEPS = 400
RATE = 0.05
#: Bytes of text looked at at once.
PIECE = 1 << 20

#: ASCII characters that are no letters part words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_SPACE = np.uint8(32)
#: A filter in front of the search for known subwords.
_FILTER_BITS = 18


def _filter_place(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


class Subwords:
    """Sorted keys of subwords (their bytes as a number), looked up in texts."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys.astype(np.uint64))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[_filter_place(self.keys)] = True

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the bytes at which known subwords start, and their numbers."""
        at, found = [], []
        for keys, inside in _windows(data):
            maybe = np.flatnonzero(self.filter[_filter_place(keys)])
            maybe = maybe[inside[maybe]]
            number = np.searchsorted(self.keys, keys[maybe])
            number[number == len(self.keys)] = 0
            known = self.keys[number] == keys[maybe] if len(self.keys) else np.zeros(len(maybe), dtype=bool)
            at.append(maybe[known])
            found.append(number[known])
        return np.concatenate(at), np.concatenate(found)


def _windows(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the key of every window, and whether it lies in one word (spaces at its ends only)."""
    space = data == _SPACE
    keys = data.astype(np.uint64)
    broken = np.zeros(len(data), dtype=bool)
    for length in range(2, min(LONGEST, len(data)) + 1):
        size = len(data) - length + 1
        keys = keys[:size] << np.uint64(8) | data[length - 1:].astype(np.uint64)
        broken = broken[:size] | space[length - 2:len(data) - 1] if length > 2 else broken[:size]
        if length >= SHORTEST:
            yield keys, ~broken
    if len(data) < SHORTEST:
        yield np.zeros(0, np.uint64), np.zeros(0, bool)


def _spaced(text: str | None) -> bytes:
    """The words, lower-cased, with a space before and after each."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def _chunks(texts: Sequence[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Bytes of several texts, or of a part of a long one, with where each begins and its number."""
    held, starts, numbers, size = [], [], [], 0
    for number, text in enumerate(texts):
        data, begin = _spaced(text), 0
        while begin < len(data):
            end = min(begin + PIECE, len(data))
            if end < len(data):
                # On to the end of the word, whose space begins the next part too.
                end = data.index(b" ", max(end - 1, begin + 1)) + 1
            held.append(data[begin:end])
            starts.append(size)
            numbers.append(number)
            size += end - begin
            begin = end - 1 if end < len(data) else end
            if size >= PIECE:
                yield b"".join(held), np.array(starts), np.array(numbers)
                held, starts, numbers, size = [], [], [], 0
    if held:
        yield b"".join(held), np.array(starts), np.array(numbers)


def _met(texts: Sequence[str | None], known: Subwords) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, word and number of each known subword met, a chunk of the texts at a time."""
    for chunk, starts, numbers in _chunks(texts):
        data = np.frombuffer(chunk, dtype=np.uint8)
        at, subword = known.places(data)
        # A subword that starts with a space is of the word behind it.
        word = np.searchsorted(np.flatnonzero(data == _SPACE), at, side="right")
        yield numbers[np.searchsorted(starts, at, side="right") - 1], word, subword


class Words(NamedTuple):
    """Words that hold known subwords: the text each is of, and their subwords one after the other."""

    text: np.ndarray
    size: np.ndarray
    subwords: np.ndarray


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Which rows, sorted by the columns, differ from the row before."""
    differs = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for column in columns:
        differs |= column[1:] != column[:-1]
    return np.append(True, differs)[:len(columns[0])]


def words_of(texts: Sequence[str | None], known: Subwords) -> Words:
    """The words of whole texts that hold known subwords, each with the distinct ones it holds, in order.

    Words of one text that hold the same subwords come once.
    """
    parts, shift = [], 0
    for text, word, subword in _met(texts, known):
        order = np.lexsort((subword, word))
        word, subword, text = word[order], subword[order], text[order]
        once = _first_of(word, subword)
        parts.append((text[once], word[once] + shift, subword[once]))
        shift += int(word[-1]) + 1 if len(word) else 0
    columns = zip(*parts) if parts else ([np.zeros(0, np.int64)],) * 3
    text, word, subword = [np.concatenate(list(c)) for c in columns]
    heads = np.flatnonzero(_first_of(word))
    if not len(heads):
        return Words(text, heads, subword)
    size = np.diff(np.append(heads, len(word)))
    # A checksum of a word's subwords says which words hold the same ones.
    spread = (subword.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mark = np.add.reduceat((spread ^ (spread >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), heads)
    order = np.lexsort((np.arange(len(heads)), mark, text[heads]))
    kept = np.zeros(len(heads), dtype=bool)
    kept[order] = _first_of(text[heads][order], mark[order])
    return Words(text[heads][kept], size[kept], subword[np.repeat(kept, size)])


class Model(NamedTuple):
    known: Subwords
    weights: np.ndarray
    bias: float
    #: What the toxic words of a text must come to for a score of one half.
    threshold: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """The toxicity of each whole text, 0 to 1."""
        return sigmoid(toxic_words(words_of(texts, self.known), self.weights, self.bias, len(texts)) - self.threshold)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def toxic_words(words: Words, weights: np.ndarray, bias: float, texts: int) -> np.ndarray:
    """The sum of the log-odds of each text's words that are toxic rather than not."""
    if not len(words.text):
        return np.zeros(texts)
    values = np.add.reduceat(weights[words.subwords], np.cumsum(words.size) - words.size) + bias
    return np.bincount(words.text, np.maximum(values, 0), texts)


class Kinds(NamedTuple):
    """Kinds of words, by the subwords they hold, and how often one is in a confirmed and in any document."""

    size: np.ndarray
    subwords: np.ndarray
    positive: np.ndarray
    unlabelled: np.ndarray


def risk(weights: np.ndarray, bias: float, kinds: Kinds, prior: float):
    """The non-negative logistic risk over words and the direction against which it is lowered, by weights and bias.

    A word counts by the documents that have it. The unlabelled risk of calling words toxic, less what
    toxic documents put into it, counts as zero where it is below, and the direction then only brings it back up.
    """
    row = np.repeat(np.arange(len(kinds.size)), kinds.size)
    z = np.bincount(row, weights[kinds.subwords], len(kinds.size)) + bias
    clean = kinds.unlabelled - prior * kinds.positive
    negative = float(clean @ np.logaddexp(0, z))
    slope = prior * kinds.positive * -sigmoid(-z) + clean * sigmoid(z) if negative >= 0 else -clean * sigmoid(z)
    total = prior * float(kinds.positive @ np.logaddexp(0, -z)) + max(0.0, negative)
    return total, np.bincount(kinds.subwords, slope[row], len(weights)), float(slope.sum())


def fit_weights(kinds: Kinds, width: int, prior: float, decay: float):
    """Weights and bias that minimise the non-negative risk, by Adam steps over all kinds of words."""
    weights, bias = np.zeros(width), 0.0
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        _, slope, slope_bias = risk(weights, bias, kinds, prior)
        gradient = np.append(slope + decay * weights, slope_bias)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def choose_threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The threshold of least non-negative 0/1 risk over held-out documents, and that risk.

    Of thresholds whose risk is as low but for a quarter of its standard error, the lowest.
    """
    values = np.unique(np.concatenate([positive, unlabelled]))
    tried = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1)
    caught = 1 - np.searchsorted(np.sort(positive), tried) / max(len(positive), 1)
    called = 1 - np.searchsorted(np.sort(unlabelled), tried) / max(len(unlabelled), 1)
    risks = prior * (1 - caught) + np.maximum(0, called - prior * caught)
    least = risks.min()
    error = np.sqrt(prior * (1 - prior) / max(len(unlabelled), 1))
    at = int(np.flatnonzero(risks <= least + error / 4)[0])
    return float(tried[at]), float(least)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the subwords that many of a task's texts have, with the number of these."""
    found, pending, texts = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in found])
        each, place = np.unique(keys, return_inverse=True)
        return each, np.bincount(place, np.concatenate([c for _, c in found]), len(each)).astype(np.int64)

    def count() -> None:
        found.append(np.unique(np.concatenate(pending), return_counts=True))
        pending.clear()
        if len(found) > 8:
            found[:] = [merged()]

    for batch in batches:
        for text in batch.column("text"):
            texts += 1
            keys = []
            for chunk, _, _ in _chunks([text.as_py()]):
                keys += [k[inside] for k, inside in _windows(np.frombuffer(chunk, dtype=np.uint8))]
            pending.append(distinct(np.concatenate(keys)))
            if sum(map(len, pending)) >= 2 * PIECE:
                count()
    if pending:
        count()
    if texts:
        keys, counts = merged()
        # What has less than half the share in every task has too little in all of them.
        often = counts >= max(1.0, LEAST_SHARE / 2 * texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[often].view(np.int64)), pa.array(counts[often])], names=["key", "n"])


def _counted(known: Subwords, wanted: str):
    """Rows (positive, text) to how many positive and unlabelled texts hold each subword, or have words of each kind.

    ``wanted`` is 'subwords' or 'kinds'. Kinds are the numbers of their subwords, as bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        numbers = np.zeros((2, len(known.keys)), dtype=np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            positive = np.array(batch.column("positive").to_pylist(), dtype=np.int64)
            if wanted == "subwords":
                met = [distinct(text * len(known.keys) + subword) for text, _, subword in _met(texts, known)]
                # A long text's chunks may meet the same subword.
                text, subword = np.divmod(distinct(np.concatenate([*met, np.zeros(0, np.int64)])), len(known.keys))
                for side in (0, 1):
                    numbers[side] += np.bincount(subword[positive[text] == side], minlength=len(known.keys))
                continue
            words = words_of(texts, known)
            ends = np.cumsum(words.size)
            ids = words.subwords.astype(np.int32)
            kinds = {(t, ids[e - s:e].tobytes()) for t, s, e in zip(words.text.tolist(), words.size.tolist(), ends.tolist())}
            for t, kind in kinds:
                seen.setdefault(kind, [0, 0])[positive[t]] += 1
            if len(seen) > KINDS:
                yield rows(seen)
                seen = {}
        if wanted == "subwords":
            here = np.flatnonzero(numbers.any(axis=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(here.astype(np.int64)), pa.array(numbers[1][here]), pa.array(numbers[0][here])], names=["subword", "p", "u"])
        else:
            yield rows(seen)

    def rows(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
        counts = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(counts[:, 1]), pa.array(counts[:, 0])], names=["kind", "p", "u"])

    return count


def _held_words(known: Subwords):
    """Rows (positive, text) to one row per batch: its texts' labels and words, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("text").to_pylist(), known)
            parts = [np.array(batch.column("positive").to_pylist(), dtype=np.int8), *[c.astype(np.int32) for c in words]]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["positive", *Words._fields])

    return pack


def _choose_subwords(sample: DataFrame, prior: float) -> Subwords:
    """Subwords that many confirmed documents and few others have."""
    part = F.pmod(F.xxhash64("doc", F.lit("part")), F.lit(16)) == 0
    counts = {bool(r["positive"]): r for r in sample.groupBy("positive").agg(F.count("*").alias("n"), F.count_if(part).alias("part")).collect()}
    positives = counts[True]["n"] if True in counts else 0
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * positives)
    # Tasks of about TOGETHER texts, so that few subwords are worth sending.
    together = sample.where("positive").select("text").coalesce(max(1, positives // TOGETHER))
    frequent = together.mapInArrow(_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = frequent.where(F.col("n") >= least).toPandas()
    if not len(found):
        return Subwords(np.zeros(0, np.uint64))
    candidates = Subwords(found["key"].to_numpy(np.int64).view(np.uint64))
    shares = (found["n"].to_numpy() / positives)[np.argsort(found["key"].to_numpy(np.int64).view(np.uint64))]

    def held(rows: DataFrame, by: Subwords) -> pd.DataFrame:
        counted = rows.select("positive", "text").mapInArrow(_counted(by, "subwords"), "subword long, p long, u long")
        return counted.groupBy("subword").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()

    others = counts[False] if False in counts else {"n": 0, "part": 0}
    if others["part"]:
        # A sixteenth of the other documents is enough to see which ones are far too common.
        few = held(sample.where(~F.col("positive") & part), candidates)
        met, count = few["subword"].to_numpy(np.int64), few["u"].to_numpy()
        common = (count - 3 * np.sqrt(count)) / others["part"]
        left = np.ones(len(candidates.keys), dtype=bool)
        left[met[2 * prior * shares[met] < LEAST_PRECISION * common]] = False
        candidates = Subwords(candidates.keys[left])
    both = held(sample, candidates)
    telling = (both["p"] >= least) & (prior * both["p"] / positives >= LEAST_PRECISION * both["u"] / max(others["n"], 1))
    return Subwords(candidates.keys[both["subword"][telling].to_numpy(np.int64)])


def _kinds(positives: DataFrame, unlabelled: DataFrame, known: Subwords) -> Kinds:
    """Counts of all kinds of words, as shares of the confirmed documents and of all documents."""
    schema = "kind binary, p long, u long"
    count = _counted(known, "kinds")
    counted = positives.mapInArrow(count, schema).unionByName(unlabelled.mapInArrow(count, schema))
    kinds = materialise(counted.groupBy("kind").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "toxicity_kinds")
    others = kinds.where("p = 0").count()
    # Kinds that no confirmed document has: about KINDS of them stand for all.
    share = min(1.0, KINDS / max(others, 1))
    chosen = kinds.where((F.col("p") > 0) | (F.pmod(F.xxhash64("kind"), F.lit(1 << 30)) < int(share * (1 << 30)))).toArrow()
    # In order, and without an object per kind.
    chosen = chosen.take(pc.sort_indices(chosen["kind"]))
    kind, p, u = (chosen[name].combine_chunks() for name in ("kind", "p", "u"))
    total = [max(df.count(), 1) for df in (positives, unlabelled)]
    p, u = p.to_numpy().astype(float), u.to_numpy().astype(float)
    size = pc.binary_length(kind).to_numpy().astype(np.int64) // 4
    subwords = np.frombuffer(kind.buffers()[2], np.int32, int(size.sum())) if len(size) else np.zeros(0, np.int32)
    return Kinds(size, subwords.astype(np.int64), p / total[0], u * np.where(p > 0, 1.0, 1 / share) / total[1])


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        toxic: str = "toxic", training: Column | None = None) -> Model:
    """The classifier learned from ``documents`` (id, text) and ``labels`` (id, toxic 0/1).

    ``training`` is a condition on the id; rows where it is not true are left out of
    everything learned. The class prior is the toxic share of the labelled training
    rows. A document with several labels is toxic if one of them says so; null ids and labels
    count for nothing, null texts as empty, repeated rows as often as they occur. Without any
    confirmed toxic document, or any subword that tells, the model gives every text the same score below one half.
    """
    training = F.lit(True) if training is None else training
    named = documents.where(training).select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    judged = (
        labels.where(training).where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull())
        .groupBy(F.col(doc_id).alias("doc")).agg((F.max(toxic) == 1).alias("toxic"))
    )
    order = (F.crc32(F.col("doc").cast("string").cast("binary")), F.col("doc"))
    all_judged, all_toxic = judged.agg(F.count("*"), F.count_if("toxic")).first()
    nothing = Model(Subwords(np.zeros(0, np.uint64)), np.zeros(0), 0.0, 30.0)
    if not all_toxic:
        return nothing
    prior = all_toxic / all_judged
    confirmed = judged.where("toxic").orderBy(*order).limit(POSITIVES).select("doc", F.lit(True).alias("positive"))
    others = (
        named.where(F.col("doc").isNotNull()).select("doc").distinct().orderBy(*order).limit(UNLABELLED)
        .select("doc", F.lit(False).alias("positive"))
    )
    # At most POSITIVES + UNLABELLED ids: this side is small at any size of the tables.
    chosen = F.broadcast(confirmed.unionByName(others))
    fifth = lambda c: F.pmod(F.xxhash64(c, F.lit("fifth")), F.lit(5)) == 0
    sample = materialise(named.join(chosen, "doc").withColumn("held", fifth("doc")), "toxicity_sample")
    learned = sample.where("NOT held")
    known = _choose_subwords(learned, prior)
    if not len(known.keys):
        return nothing
    unlabelled = named.where(~F.coalesce(fifth("doc"), F.lit(False))).select(F.lit(False).alias("positive"), "text")
    kinds = _kinds(learned.where("positive").select("positive", "text"), unlabelled, known)

    packed = sample.where("held").select("positive", "text").mapInArrow(
        _held_words(known), "positive binary, text binary, size binary, subwords binary").collect()
    held = [(np.frombuffer(r["positive"], np.int8) > 0, Words(*[np.frombuffer(r[c], np.int32) for c in Words._fields])) for r in packed]
    best = None
    for decay in DECAYS:
        weights, bias = fit_weights(kinds, len(known.keys), prior, decay)
        values = [toxic_words(words, weights, bias, len(positive)) for positive, words in held]
        sides = [np.concatenate([v[p == side] for (p, _), v in zip(held, values)] or [np.zeros(0)]) for side in (True, False)]
        # Too few documents to choose with: what the loss itself takes for one half.
        threshold, least = choose_threshold(*sides, prior) if min(map(len, sides)) else (0.0, 0.0)
        if best is None or least < best[0]:
            best = (least, Model(known, weights, bias, threshold))
    return best[1]


def score(documents: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``documents`` with the toxicity of each whole text, 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.where(texts.notna(), None).tolist()), dtype="float64")

    return documents.withColumn(into, toxicity(F.col(text)))
