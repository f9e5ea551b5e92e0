"""Continuous post sync over landed API pages."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from talkloom.functions.messages import MODEL_ROLE
from talkloom.operators import sync
from talkloom.session import materialise
from talkloom.sources.api_pages import landed_pages, page_posts
from talkloom.sources.state import append_posts, ledger_ids, merge_ledger, seed_ledger


def start_post_sync(
    spark: SparkSession,
    pages: str,
    out: str,
    state: str,
    checkpoint: str,
    min_len: int = 10,
    exclude_sources: Collection[str] = (),
    include_replies: bool = True,
    no_quotes: bool = False,
    role: str = MODEL_ROLE,
    multiline: bool = False,
) -> StreamingQuery:
    """Append new posts as pages land; stops once all present pages are done.

    The stream delivers each page file once, so no high-water mark is needed;
    repeated posts are told by their id against the ledger. Batches are named
    after the query and batch number, and a replayed batch overwrites itself.
    """
    ledger = f"{state}/id-buckets"

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        owner = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        name = f"{owner}-{number}"
        seed_ledger(session, ledger, out, owner)
        feed = page_posts(batch, include_replies=include_replies)
        merge_ledger(session, ledger, name)
        known = ledger_ids(session, ledger, name, among=feed.select(sync.post_id(feed).alias("tweet_id")))
        new = sync.new_posts(
            feed, known, min_len=min_len, exclude_sources=exclude_sources, no_quotes=no_quotes
        )
        new = materialise(new, "new-posts")
        append_posts(sync.sync_examples(new, role), out, ledger, name)

    return (
        landed_pages(spark, pages, streaming=True, multiline=multiline)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
