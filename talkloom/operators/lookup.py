"""Joins and keep-first selection that hold up when one key owns much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores behind it as no column of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_first(df: DataFrame, key: str | list[str], order: str | Column) -> DataFrame:
    """First row per key in ``order``.

    Spark limits each key to one row per input partition before the shuffle
    (WindowGroupLimit), so a hot key arrives already reduced.
    """
    keys = [key] if isinstance(key, str) else key
    first = Window.partitionBy(*keys).orderBy(order)
    nth = free_name("_nth", df)
    return df.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)


def lookup(probe: DataFrame, build: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Many-to-one join that adaptive execution can split on a hot key.

    ``build`` has one row per key, usually out of an aggregation on that key.
    Joining on the key and its hash gives both sides an exchange of their own;
    reusing the aggregation's partitioning would rule out the skew split. Probe
    rows without a key match nothing; the hash of the whole row spreads them.
    """
    keys = [on] if isinstance(on, str) else on
    has_key = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    spread = F.when(has_key, F.xxhash64(*keys)).otherwise(F.xxhash64(*probe.columns))
    key_hash = free_name("_key_hash", probe, build)
    joined = probe.withColumn(key_hash, spread).join(
        build.withColumn(key_hash, F.xxhash64(*keys)), [*keys, key_hash], how
    )
    return joined.drop(key_hash)


def unseen(df: DataFrame, existing: DataFrame, on: str | list[str], among: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose key is not in ``existing``.

    The usually far larger ``existing`` side is first cut down to the keys that
    occur in ``among`` (default: ``df``, which then is computed twice); Spark
    broadcasts that key list by itself when it is small.
    """
    keys = [on] if isinstance(on, str) else on
    asked = (df if among is None else among).select(*keys).distinct()
    hits = existing.select(*keys).join(asked, keys, "left_semi").distinct()
    return lookup(df, hits, keys, "left_anti")
