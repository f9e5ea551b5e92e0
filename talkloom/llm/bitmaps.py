"""Fixed-size filters that keep rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words of 64 bits of a filter: 128 kB, whatever the number of values.
WORDS = 1 << 14


def may_be_in(value: Column, values: DataFrame, name: str, words: int = WORDS) -> Column:
    """True for every ``value`` (a 64-bit integer) among column ``name`` of ``values``, and for few others.

    The filter is one array of ``words`` numbers, computed once as a scalar subquery. With
    many more values than it has bits it lets everything through; an exact join must follow.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    place = lambda b: F.floor(b / 64).cast("int")
    mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    set_bits = values.where(F.col(name).isNotNull()).select(bit(F.col(name)).alias("b")).select(
        place(F.col("b")).alias("word"), mask(F.col("b")).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    every = values.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    filled = every.unionByName(set_bits).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bitmap = filled.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("all")).select(
        F.transform("all", lambda w: w["mask"]).alias("bitmap"))
    b = bit(value)
    return F.get(bitmap.scalar(), place(b)).bitwiseAND(mask(b)) != 0
