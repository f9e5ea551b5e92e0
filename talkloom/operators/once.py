"""Columns that are computed once, however often later steps refer to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df.withColumn(name, column)`` that later filters and projections cannot inline.

    Spark pushes filters below a projection and repeats the projected expression
    in each reference; for long text expressions that multiplies the work. It
    leaves the output of an explode alone, and exploding an array of one keeps
    the rows as they are.
    """
    others = [F.col(c) for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(F.array(column)).alias(name))
