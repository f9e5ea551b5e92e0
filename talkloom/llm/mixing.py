"""Mixing a corpus to target weights by iterative proportional fitting.

Documents fall into cells: one for each combination of values of the dimensions
(source, language, topic). Raking scales the cells' token weights to the target share
of each value of each dimension in turn, round after round, until all margins agree.
The weight of a cell over its tokens is its rate. Documents are sampled with a probability
in proportion to the rate, and none is repeated. The scale comes from the corpus that is
wanted: a share of all tokens. Cells that would need a probability over 1 are kept whole, and the
others make up for what they lack. Without a wanted share the scale is one over the highest rate,
which keeps the raked mix in expectation, but lets the rarest cell decide how much is left.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkloom.operators.lookup import free_name, lookup
from talkloom.session import materialise, settings

ROUNDS = 10
#: With a bound, raking goes on until every margin is within it of its target, relative to the target. It
#: ends too after MOST_ROUNDS, or when STORED rounds neither lower the largest error by a hundredth of it nor
#: change the sum of all errors by more than the bound: targets of values that only occur together can
#: contradict each other.
BOUND, MOST_ROUNDS = 0.001, 50
#: Rounds between two stored tables.
STORED = 2
#: Cells to a partition of raking, at most.
CELLS = 10_000
#: Share of all tokens that the registered query and the pipeline keep.
KEEP = 0.9
#: Default target: a value's share is in proportion to its tokens to this power.
TEMPERATURE = 0.9
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"

#: Topics by what a text holds, in order of precedence.
TOPICS = (
    ("licence", ("Licensed under", "licensed under", "Copyright", "All rights reserved")),
    ("table", (" | ",)),
    ("contact", ("@",)),
    ("list", ("***", "###", "$$$", "%%%", "&&&")),
)
OTHER_TOPIC = "prose"

log = logging.getLogger(__name__)


def topic(text: Column) -> Column:
    """The first topic one of whose marks the text contains."""
    found = F.lit(OTHER_TOPIC)
    for name, marks in reversed(TOPICS):
        held = F.lit(False)
        for mark in marks:
            held = held | text.contains(mark)
        found = F.when(held, name).otherwise(found)
    return found


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) that the key alone decides: the first 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit(NONE)))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def _planned_once(cells: DataFrame) -> AbstractContextManager[None]:
    """Have what is done with ``cells``, a stored table, planned once instead of anew after each of its exchanges.

    Cells are few beside documents, their exchanges many. With adaptive execution each exchange is a job with a thread
    of its own on the driver, which also plans all that is left again. What that would gain, few
    partitions for few rows, is known from the count of the cells.
    """
    spark, partitions = cells.sparkSession, 1 + cells.count() // CELLS
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": min(partitions, most)})


def tempered(cells: DataFrame, dimension: str, power: float = TEMPERATURE) -> DataFrame:
    """value, share: the tokens of each value to a power, scaled to a sum of 1."""
    of_value = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))
    total = of_value.agg(F.sum("share")).first()[0] or 1.0
    return of_value.withColumn("share", F.col("share") / total)


def margins(cells: DataFrame, targets: dict[str, DataFrame], weight: Column) -> DataFrame:
    """dimension, value, share (the target), reached and error (reached over share, less 1) of each value that has weight or tokens."""
    parts = []
    for dimension, target in targets.items():
        reached = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum(weight).alias("w"))
        total = reached.agg(F.sum("w").alias("all"))
        parts.append(reached.join(target, "value", "left").crossJoin(total).select(
            F.lit(dimension).alias("dimension"), "value", F.coalesce("share", F.lit(0.0)).alias("share"),
            F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0).alias("reached")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("error", F.when(F.col("share") > 0, F.col("reached") / F.col("share") - 1))


def _raked_once(cells: DataFrame, dimensions: Sequence[str], total: float) -> DataFrame:
    """``cells`` after one round: the weights scaled to the share of each dimension in turn."""
    for dimension in dimensions:
        now = F.sum("weight").over(Window.partitionBy(dimension))
        share = F.col(f"_share_{dimension}")
        cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * (share * total / now)).otherwise(0.0))
    return cells


def _with_errors(cells: DataFrame, dimensions: Sequence[str], total: float) -> DataFrame:
    """``cells`` with the largest error of their values, and the sum of all values' errors spread over cells."""
    largest, shared = F.lit(0.0), F.lit(0.0)
    for dimension in dimensions:
        # Values without tokens cannot reach a share.
        value = Window.partitionBy(dimension)
        counted = F.sum(F.when(F.col("tokens") > 0, 1.0)).over(value)
        share = F.col(f"_share_{dimension}") * total
        error = F.when((F.col("tokens") > 0) & (share > 0), F.abs(F.sum("weight").over(value) / share - 1))
        cells = cells.withColumn(f"_error_{dimension}", error).withColumn(f"_part_{dimension}", error / counted)
        largest = F.greatest(largest, F.coalesce(F.col(f"_error_{dimension}"), F.lit(0.0)))
        shared = shared + F.coalesce(F.col(f"_part_{dimension}"), F.lit(0.0))
    return cells.withColumn("_error", largest).withColumn("_errors", shared).drop(
        *[f"_{c}_{d}" for d in dimensions for c in ("error", "part")])


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, bound: float | None = None) -> DataFrame:
    """``cells`` (the dimensions, tokens) with ``weight``, raked to ``targets`` (value, share per dimension).

    The weights sum up to the tokens of all cells. Values without a target get no weight;
    targets without a cell are left out, and the rest is scaled to fill their place.
    With a ``bound``, rounds go on until the largest error of :func:`margins` is within it, see BOUND;
    an error that is left is logged. The table is stored every STORED rounds, which are window sums in one plan.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    dimensions, columns = list(targets), cells.columns
    raked = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        share = target.select(F.col("value").alias(dimension), F.col("share").alias(f"_share_{dimension}"))
        raked = lookup(raked, share, dimension).fillna(0.0, [f"_share_{dimension}"])
    raked = materialise(raked, "cells")
    most, done, last, error = rounds if bound is None else MOST_ROUNDS, 0, None, None
    while done < most:
        step = min(STORED, most - done)
        for _ in range(step):
            raked = _raked_once(raked, dimensions, total)
        done += step
        raked = materialise(_with_errors(raked, dimensions, total) if bound is not None else raked, f"cells_{done}")
        if bound is None:
            continue
        error, errors = raked.agg(F.coalesce(F.max("_error"), F.lit(0.0)), F.coalesce(F.sum("_errors"), F.lit(0.0))).first()
        raked = raked.drop("_error", "_errors")
        if error <= bound or last is not None and error > 0.99 * last[0] and abs(last[1] - errors) <= bound:
            break
        last = error, errors
    if bound is not None and error is not None and error > bound:
        log.warning("raking ended after %d rounds with a margin %.3g off its target, relative to it", done, error)
    return raked.select(*columns, "weight")


def scale_to(rated: DataFrame, keep: float) -> float:
    """The factor of the rates with which the probabilities, at most 1, keep ``keep`` of all tokens; inf if nothing less does.

    Tokens kept grow with the factor along a concave line of straight pieces, so that
    tangents from the left arrive at it after finitely many steps.
    """
    scale, whole = 0.0, None
    while True:
        capped = (F.col("rate") * scale >= 1) & (F.col("rate") > 0)
        all_tokens, kept_whole, weight, cells = rated.where("tokens > 0").agg(
            F.sum("tokens"), F.sum(F.when(capped, F.col("tokens")).otherwise(0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.count(F.when(capped, 1))).first()
        if not all_tokens or cells == whole:
            return scale
        if not weight:
            return float("inf")
        scale, whole = max(scale, (keep * all_tokens - kept_whole) / weight), cells


def with_cells(documents: DataFrame, names: Sequence[str] = ("source", "lang", "topic"), text: str = "text",
               source: str = "source", lang: str = "lang", topic_of: Column | None = None) -> DataFrame:
    """``documents`` with the source, language and topic that count, under the given names; null is ``(none)``."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    subject = topic(F.col(text)) if topic_of is None else topic_of
    values = (named(source), named(lang), F.coalesce(subject, F.lit(OTHER_TOPIC)))
    return documents.withColumns(dict(zip(names, values)))


def describe(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             lang: str = "lang", topic_of: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every row; words count as tokens."""
    cells = with_cells(documents, ("_source", "_lang", "_topic"), text, source, lang, topic_of)
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return cells.select(
        F.col(doc_id).alias("doc_id"), F.col("_source").alias("source"), F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"), words.alias("tokens"))


def rates(described: DataFrame, dimensions: Sequence[str] = ("source", "lang", "topic"),
          targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, keep: float | None = None,
          bound: float | None = None) -> DataFrame:
    """The dimensions and rate and probability of each cell; cells without tokens have the probability 1.

    ``targets`` gives (value, share) per dimension; the default is :func:`tempered`. ``keep`` is the share of
    all tokens that is wanted, in expectation; without it no cell but that of the highest rate is kept whole.
    What cells kept whole lack is logged as the margins' largest error.
    """
    cells = materialise(described.groupBy(*dimensions).agg(F.sum("tokens").alias("tokens")), "cell_tokens")
    with _planned_once(cells):
        # Stored, as raking and the margins of the sample both read them.
        wanted = targets or {d: materialise(tempered(cells, d), "target") for d in dimensions}
        raked = rake(cells, wanted, rounds, bound)
        rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
        rated = raked.withColumn("rate", rate)
        if keep is None:
            highest = rated.agg(F.max("rate")).first()[0] or 1.0
            return rated.select(*dimensions, "rate", F.coalesce(F.col("rate") / highest, F.lit(1.0)).alias("probability"))
        # A rate of 0 stays 0, whatever the scale.
        scaled = F.when(F.col("rate") > 0, F.least(F.lit(1.0), F.col("rate") * scale_to(rated, keep))).otherwise(F.col("rate"))
        chosen = rated.withColumn("probability", F.coalesce(scaled, F.lit(1.0)))
        off = margins(chosen.where("tokens > 0"), wanted, F.col("tokens") * F.col("probability")).orderBy(
            F.desc(F.abs("error")), "dimension", "value").first()
    if off is not None and off.error is not None:
        log.warning("the mix keeps %.3g of the tokens; furthest off is %s %s: share %.3g instead of %.3g",
                    keep, off.dimension, off.value, off.reached, off.share)
    return chosen.select(*dimensions, "rate", "probability")


def mix(described: DataFrame, dimensions: Sequence[str] = ("source", "lang", "topic"),
        targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, salt: str = "mix", keep: float | None = None,
        bound: float | None = None) -> DataFrame:
    """``described`` with weight (raked tokens), probability and sampled for every row.

    A document's id alone decides its draw: rows with the same id, source, language and
    topic are sampled together. Columns of these three names in ``described`` are replaced.
    """
    cell, rate, share = (free_name(name, described) for name in ("_cell", "_rate", "_probability"))
    rated = rates(described, dimensions, targets, rounds, keep, bound).select(
        *dimensions, F.xxhash64(*dimensions).alias(cell), F.col("rate").alias(rate), F.col("probability").alias(share))
    joined = lookup(described.withColumn(cell, F.xxhash64(*dimensions)), rated, [*dimensions, cell])
    return joined.select(
        *[c for c in described.columns if c not in ("weight", "probability", "sampled")],
        (F.col("tokens") * F.coalesce(rate, F.lit(0.0))).alias("weight"), F.col(share).alias("probability"),
        (uniform(F.col("doc_id"), salt) < F.col(share)).alias("sampled"))
