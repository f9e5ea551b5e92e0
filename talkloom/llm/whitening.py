"""Whitening of embeddings from exact, bit-sliced cross-products.

Entries become whole numbers. Each dimension is shifted by its least value, so that what
is left is small and not negative, and is cut into bit planes: plane b of a dimension has
one bit per row, packed into 64-bit words across rows. The sum of x * y over rows is then
the sum over all plane pairs of ``2 ** (b + c)`` times the number of rows that have a bit in
both planes, an AND and a population count. Tasks only count; the counts of equal weight are
added up by Spark, and the driver puts them together as Python integers. ``n * sum(xy) -
sum(x) * sum(y)`` is centred without rounding before anything becomes floating point.

What reaches the driver has the size of the covariance matrix times twice the number of
planes, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Rows whose planes are packed at once; a multiple of 64.
BLOCK = 4_096
#: Entries beyond this have no exact whole number in a double with room for the offset.
LARGEST = float(2**52)
#: Eigenvalues below this part of the largest one are rounding; their directions have no variance.
RANK = 1e-12


class Model(NamedTuple):
    """What the fit learned: ``sums`` and the covariance are exact until the eigenvectors are taken."""

    dimension: int
    n: int
    sums: list[int]
    least: np.ndarray
    greatest: np.ndarray
    eigenvalues: np.ndarray
    #: One row per component.
    vectors: np.ndarray
    trace: float


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of whole numbers >= 0 (rows, dimensions) as words: (dimensions, bits, words)."""
    rows, width = values.shape
    words = -(-rows // 64)
    packed = np.zeros((width, bits, words * 8), dtype=np.uint8)
    for d in range(width):
        column = np.ascontiguousarray(values[:, d])
        for b in range(bits):
            plane = np.packbits((column >> b & 1).astype(bool), bitorder="little")
            packed[d, b, :len(plane)] = plane
    return packed.view(np.uint64)


def count_products(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """i and, for each dimension j >= i and weight s, how often planes b of i and c of j with b + c = s have a row in common."""
    sliced = planes(values, bits)
    for i in range(len(sliced)):
        found = np.zeros((len(sliced) - i, 2 * bits - 1), dtype=np.int64)
        for b in range(bits):
            found[:, b:b + bits] += np.bitwise_count(sliced[i, b] & sliced[i:]).sum(axis=2, dtype=np.int64)
        yield i, found


def whole(vectors: pa.ListArray | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """The whole numbers of vectors that all have ``dimension`` entries."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dimension) + OFFSET


def usable(embeddings: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite entries only; entries beyond LARGEST count as not finite."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST / SCALE)
    return embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry))


def _dimension(rows: DataFrame) -> int | None:
    """The commonest length of a vector, of several the largest."""
    found = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return found and found["width"]


def _ranges(rows: DataFrame, dimension: int):
    """n, and sum, least and greatest whole number of each dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimension, dtype=object)
        low, high = np.full(dimension, 2**62), np.full(dimension, -2**62)
        for batch in batches:
            x = whole(batch.column("vector"), dimension)
            if len(x):
                n, low, high = n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
                # Halves and Python integers, as a task's rows may add up to more than 64 bits.
                high_half, low_half = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = total + high_half.astype(object) * 2**32 + low_half.astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dimension)), pa.array(np.full(dimension, n)), pa.array(total.tolist(), pa.decimal128(38, 0)), pa.array(low), pa.array(high)],
                names=["i", "n", "total", "low", "high"])

    found = rows.select("vector").mapInArrow(summed, "i long, n long, total decimal(38,0), low long, high long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"),
        F.max("high").alias("high")).orderBy("i").collect()
    return found[0]["n"], [int(r["total"]) for r in found], np.array([r["low"] for r in found]), np.array([r["high"] for r in found])


def _products(rows: DataFrame, dimension: int, least: np.ndarray, bits: int) -> dict[tuple[int, int], int]:
    """Exact sums over all rows of (x_i - least_i) * (x_j - least_j), for i <= j."""
    weights = [f"w{s}" for s in range(2 * bits - 1)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        total = [np.zeros((dimension - i, 2 * bits - 1), dtype=np.int64) for i in range(dimension)]

        def add(values: np.ndarray) -> None:
            for start in range(0, len(values), BLOCK):
                for i, found in count_products(values[start:start + BLOCK], bits):
                    total[i] += found

        for batch in batches:
            held.append(whole(batch.column("vector"), dimension) - least)
            size += len(held[-1])
            if size >= BLOCK:
                add(np.concatenate(held))
                held, size = [], 0
        if held:
            add(np.concatenate(held))
        for i in range(dimension):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dimension - i, i)), pa.array(np.arange(i, dimension)), *[pa.array(c) for c in total[i].T.copy()]],
                names=["i", "j", *weights])

    schema = "i long, j long, " + ", ".join(f"{w} long" for w in weights)
    added = rows.select("vector").mapInArrow(counted, schema).groupBy("i", "j").agg(*[F.sum(w).alias(w) for w in weights])
    return {(r["i"], r["j"]): sum(int(r[w]) << s for s, w in enumerate(weights)) for r in added.collect()}


def fit(embeddings: DataFrame, vector: str = "embedding") -> Model | None:
    """Eigenvectors of the covariance of the whole numbers of all usable vectors; None without any.

    The divisor is the number of vectors; repeated rows count as often as they occur. Only
    vectors of the commonest length take part. Components without variance are left out.
    """
    rows = usable(embeddings, vector).select(F.col(vector).alias("vector"))
    dimension = _dimension(rows)
    if dimension is None:
        return None
    rows = rows.where(F.size("vector") == dimension)
    n, sums, least, greatest = _ranges(rows, dimension)
    bits = max(1, int((greatest - least).max()).bit_length())
    products = _products(rows, dimension, least, bits)
    shifted = [s - n * int(low) for s, low in zip(sums, least)]
    covariance = np.zeros((dimension, dimension))
    for (i, j), total in products.items():
        # Whole numbers until here; the quotient of two of them is rounded once.
        covariance[i, j] = covariance[j, i] = (n * total - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    kept = [k for k in order if values[k] > max(0.0, RANK * values[order[0]])]
    return Model(dimension, n, sums, least, greatest, values[kept], vectors[:, kept].T, float(np.trace(covariance)))


def _project(x: np.ndarray, model: Model, components: int) -> np.ndarray:
    mean = np.array([s / model.n for s in model.sums])
    return (x - mean) @ model.vectors[:components].T / np.sqrt(model.eigenvalues[:components])


def identity_error(rows: DataFrame, model: Model, components: int) -> float:
    """The largest absolute entry of the whitened rows' own covariance minus the identity.

    Tasks send counts, sums and cross-products of their whitened rows, which are centred already but for rounding.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _project(whole(batch.column("vector"), model.dimension), model, components)
            extended = np.hstack([np.ones((len(z), 1)), z])
            total = extended.T @ extended
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "total"])

    found = rows.select("vector").mapInArrow(summed, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    total = np.zeros((components + 1, components + 1))
    for r in found.collect():
        total[r["i"], r["j"]] = r["total"]
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(components)).max())


def _deviations(x: np.ndarray, model: Model) -> list[int]:
    """Per row the exact sum of (n * x - S) ** 2."""
    # The sums' range says whether 64 bits hold every square and their sum.
    reach = [max(abs(model.n * int(b) - s) for b in (low, high)) for s, low, high in zip(model.sums, model.least, model.greatest)]
    kind = np.int64 if sum(r * r for r in reach) < 2**63 else object
    off = x.astype(kind) * model.n - np.array(model.sums, dtype=kind)
    return [int(d) for d in (off * off).sum(axis=1)]


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry (or one beyond 2 ** 42,
    which has no exact whole number) are left out, as are vectors of another than the commonest
    length. Null ids stay. Repeated rows come back as often as they occur. ``component`` counts from
    1 by falling eigenvalue, at most ``components``; directions without variance have none, so that a
    table of equal vectors, or an empty one, gives no row. ``deviation`` is a decimal(38, 0), null
    beyond that. Further columns of the input play no part.
    """
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(embeddings, vector)
    rows = usable(embeddings, vector).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    k = min(components, len(model.eigenvalues)) if model else 0
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == model.dimension)
    error = identity_error(rows, model, k)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("vector"), model.dimension)
            m = len(x)
            ids = batch.column("vec_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            deviation = [d if d < 10**38 else None for d in _deviations(x, model)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids.repeat(k), pa.int64()), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, model.n)), pa.array([d for d in deviation for _ in range(k)], pa.decimal128(38, 0)),
                pa.array(_project(x, model, k).ravel()), pa.array(np.tile(model.eigenvalues[:k] / model.trace, m)),
                pa.array(np.full(m * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, schema)
