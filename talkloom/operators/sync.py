"""Incremental post sync: filters, id anti-join, high-water mark."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.functions.messages import MODEL_ROLE, POST_PROMPT, style_example
from talkloom.functions.times import next_start, parse_ts
from talkloom.operators.lookup import keep_first, unseen
from talkloom.operators.posts import post_id, unify_posts

START_OF_TIME = "1970-01-01T00:00:00Z"


def references(df: DataFrame, *types: str) -> Column:
    """The post refers to another post in one of the given ways."""
    if "referenced_tweets" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.exists("referenced_tweets", lambda r: r["type"].isin(*types)), F.lit(False))


def since(df: DataFrame, start_time: str | None) -> DataFrame:
    """Posts at or after the mark; posts without a readable time stay."""
    if start_time is None:
        return df
    return df.where(F.coalesce(parse_ts(F.col("created_at")) >= parse_ts(F.lit(start_time)), F.lit(True)))


def syncable_posts(
    feed: DataFrame, min_len: int = 10, exclude_sources: Collection[str] = (), no_quotes: bool = False
) -> DataFrame:
    """Feed posts that pass the filters: tweet_id, text, created_at, ord of the first row per id."""
    kept = feed.where(~references(feed, "quoted")) if no_quotes else feed
    if exclude_sources and "source" in feed.columns:
        kept = kept.where(~F.coalesce(F.col("source"), F.lit("")).isin(*exclude_sources))
    # What the examples do without is not computed.
    unified = unify_posts(kept).select("id_str", "text", "created_at", "ord")
    long_enough = unified.where(F.length("text") >= min_len)
    return keep_first(long_enough.withColumnRenamed("id_str", "tweet_id"), "tweet_id", "ord")


def new_posts(feed: DataFrame, existing: DataFrame, **filters) -> DataFrame:
    """Posts of the feed that are not yet in ``existing`` (column tweet_id)."""
    ids = feed.select(post_id(feed).alias("tweet_id"))
    return unseen(syncable_posts(feed, **filters), existing, "tweet_id", among=ids)


def sync_examples(posts: DataFrame, role: str = MODEL_ROLE) -> DataFrame:
    return posts.select("tweet_id", style_example(F.col("text"), POST_PROMPT, role).alias("messages"), "ord")


def next_mark(posts: DataFrame, mark: str = START_OF_TIME) -> DataFrame:
    """One row ``start_time``: newest kept creation time plus a second; no posts, no change."""
    newest = F.greatest(F.max("created_at"), F.lit(mark))
    return posts.agg(F.count(F.lit(1)).alias("_posts"), newest.alias("_newest")).select(
        F.when(F.col("_posts") > 0, next_start(F.col("_newest"))).otherwise(F.lit(mark)).alias("start_time")
    )
