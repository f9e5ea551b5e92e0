"""Exact-count selections by rank, without sending all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.operators.examples import shuffle_rank
from talkloom.session import materialise

DIGITS = 4  # hex digits per histogram: at most 65,536 counts reach the driver


def eval_size(rows: int, eval_pct: float) -> int:
    """At least one evaluation row, never all rows; halves round to even."""
    return min(max(1, round(rows * eval_pct)), rows - 1) if rows > 1 else 0


def _boundary(ranks: DataFrame, size) -> str | None:
    """The rank at and above which exactly ``size(total)`` rows lie."""
    prefix, wanted = "", None
    while True:
        bucket = ranks.where(F.startswith("_rank", F.lit(prefix))) if prefix else ranks
        counts = {
            row[0]: row[1]
            for row in bucket.groupBy(F.substring("_rank", len(prefix) + 1, DIGITS)).count().collect()
        }
        if wanted is None:
            wanted = size(sum(counts.values()))
            if wanted == 0:
                return None
        for digits in sorted(counts, reverse=True):
            if counts[digits] >= wanted:
                break
            wanted -= counts[digits]
        prefix += digits
        if counts[digits] == wanted:
            return prefix
        if not digits:
            raise ValueError("split needs a unique key, or a unique tie column besides it")


def split(
    df: DataFrame, key: str, eval_pct: float = 0.05, seed: int = 42, tie: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, eval): the tail of the seeded shuffle, exactly ``eval_size`` rows.

    A histogram over the leading digits of the shuffle rank finds the boundary;
    the two sides are then plain filters. ``key`` must be unique unless ``tie``
    tells equal keys apart.
    """
    rank = shuffle_rank(seed, F.col(key))
    if tie is not None:
        rank = F.concat(rank, shuffle_rank(seed, F.to_json(F.struct(tie))))
    ranks = materialise(df.select(rank.alias("_rank")), "split-ranks")
    boundary = _boundary(ranks, lambda total: eval_size(total, eval_pct))
    if boundary is None:
        return df, df.where(F.lit(False))
    return df.where(rank < boundary), df.where(rank >= boundary)


def sorted_keys(df: DataFrame, order: Sequence[Column], payload: Sequence[Column] = ()) -> DataFrame:
    """Sort keys (``_key``) in a range-partitioned, written table with ``_part`` and ``_row``."""
    keys = df.select(F.struct(*order).alias("_key"), *payload).orderBy("_key")
    at = F.monotonically_increasing_id()
    # The id holds the partition above bit 33 and the row within it below.
    return materialise(keys.withColumn("_at", at), "sorted-keys").select(
        "*",
        F.shiftright("_at", 33).alias("_part"),
        F.col("_at").bitwiseAND(F.lit(2**33 - 1)).alias("_row"),
    ).drop("_at")


def positions(df: DataFrame, order: Sequence[Column], payload: Sequence[Column]) -> DataFrame:
    """``payload`` columns and their global position (from 0) in ``order``.

    Each sorted partition knows its own row numbers; only one count per
    partition is combined centrally.
    """
    keys = sorted_keys(df, order, payload)
    counts = sorted((row[0], row[1]) for row in keys.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, rows in counts:
        offsets.append((part, total))
        total += rows
    offset_table = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    # One row per sorted partition: bounded by the number of partitions.
    return (
        keys.join(F.broadcast(offset_table), "_part")
        .withColumn("position", F.col("_offset") + F.col("_row"))
        .drop("_key", "_part", "_row", "_offset")
    )


def holdout_size(rows: int, eval_pct: float) -> int:
    return round(rows * eval_pct)


def tail_split(df: DataFrame, order: Sequence[Column], eval_pct: float) -> tuple[DataFrame, DataFrame]:
    """(rest, tail): the last ``holdout_size`` rows in ``order``, whose keys are unique."""
    if eval_pct <= 0:
        return df, df.where(F.lit(False))
    keys = sorted_keys(df, order)
    counts = sorted((row[0], row[1]) for row in keys.groupBy("_part").count().collect())
    wanted = holdout_size(sum(rows for _, rows in counts), eval_pct)
    if wanted == 0:
        return df, df.where(F.lit(False))
    for part, rows in reversed(counts):
        if rows >= wanted:
            break
        wanted -= rows
    edge = keys.where((F.col("_part") == part) & (F.col("_row") == rows - wanted)).select("_key")
    in_tail = F.struct(*order) >= edge.scalar()
    return df.where(~in_tail), df.where(in_tail)
