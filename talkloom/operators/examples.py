"""Normalising, repairing and deduplicating example rows (one dialog per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.functions.messages import (
    MESSAGES, PLACEHOLDER_PROMPT, REPAIRABLE, answer_key, decoded_messages, filled_messages,
    has_generic_prompt, is_repost, merge_runs, message, role_shape, untagged_answer, untagged_messages,
)
from talkloom.operators.lookup import keep_first
from talkloom.operators.once import compute_once
from talkloom.operators.packed import exchange_first

DEFAULT_KEEP = ("messages", "created_at")
INTERNAL = ("source_file", "ord")


def repairable(df: DataFrame, filled: Column) -> DataFrame:
    """Dialogs whose roles can be made to alternate, told from the roles alone."""
    return df.where(F.rlike(role_shape(filled), F.lit(REPAIRABLE)))


def repair_roles(df: DataFrame) -> DataFrame:
    """Merge same-role runs and keep the dialogs that alternate system?, user, assistant, …"""
    return merge_and_trim(repairable(df, F.col("messages")))


def merge_and_trim(df: DataFrame) -> DataFrame:
    """Merge same-role runs, supply a missing opening prompt, drop a trailing non-answer."""
    m = F.col("_merged")
    role_at = lambda i: F.get(m, i)["role"]
    prompt = F.array(message("user", F.lit(PLACEHOLDER_PROMPT)))
    opening = F.when(role_at(F.lit(0)) == "assistant", prompt).otherwise(F.array().cast(MESSAGES))
    trailing = (role_at(F.size(m) - 1) != "assistant").cast("int")
    repaired = F.concat(opening, F.slice(m, F.lit(1), F.size(m) - trailing))
    merged = compute_once(df, "_merged", merge_runs(F.col("messages")))
    return compute_once(merged, "messages", repaired).drop("_merged")


def normalize_examples(df: DataFrame, keep: Sequence[str] = DEFAULT_KEEP) -> DataFrame:
    """Clean messages, drop reposts, repair roles, keep the asked-for columns.

    Dialogs beyond repair go first: their roles tell before any text is cleaned.
    """
    columns = ["messages", *[k for k in keep if k != "messages" and k in df.columns]]
    columns += [c for c in INTERNAL if c in df.columns]
    rows = repairable(df.select(*columns).where(F.col("messages").isNotNull()), filled_messages(F.col("messages")))
    untagged = compute_once(rows, "messages", untagged_messages(F.col("messages")))
    cleaned = compute_once(untagged, "messages", decoded_messages(F.col("messages")))
    return merge_and_trim(cleaned.where(~is_repost(F.col("messages"))))


def keyed_examples(df: DataFrame) -> DataFrame:
    """Adds ``dedup_key``, the dialog key."""
    answered = compute_once(df, "_answer", untagged_answer(F.col("messages")))
    return answered.withColumn("dedup_key", answer_key(F.col("_answer"))).drop("_answer")


def dedup_examples(df: DataFrame, order: str | Column = "ord") -> DataFrame:
    """First row per dialog key; adds ``dedup_key``."""
    return keep_first(keyed_examples(df), "dedup_key", order)


def drop_generic(df: DataFrame) -> DataFrame:
    """Drop rows with a generic last prompt; run before deduplication."""
    return df.where(~has_generic_prompt(F.col("messages")))


def shuffle_rank(seed: int, key: Column) -> Column:
    """Position in the seeded shuffle: an MD5 that is uniform whatever the keys are."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows in seeded random order.

    The rank is uniform, so partitions are cut by its leading digits: a total
    order without the sampling pass of a range sort.
    """
    parts = _shuffle_parts(df)
    ranked = df.withColumn("_rank", shuffle_rank(seed, F.col(key)))
    return ranked.repartitionById(parts, _rank_part(F.col("_rank"), parts)).sortWithinPartitions("_rank").drop("_rank")


def shuffled_first(df: DataFrame, seed: int, key: str, order: str = "ord") -> DataFrame:
    """What :func:`shuffled` makes of the first row per key, with one exchange of the rows for both.

    Rows of one key have one rank, so they meet where the shuffle takes them.
    """
    parts = _shuffle_parts(df)
    rank = shuffle_rank(seed, F.col(key))
    met = exchange_first(df, key, order, _rank_part(rank, parts), parts)
    return met.withColumn("_rank", rank).sortWithinPartitions("_rank").drop("_rank")


def _shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _rank_part(rank: Column, parts: int) -> Column:
    leading = F.conv(F.substring(rank, 1, 8), 16, 10).cast("bigint")
    return F.floor(leading * parts / F.lit(2**32)).cast("int")
