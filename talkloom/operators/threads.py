"""Forum tables: column mapping, ancestor chains, per-reply examples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.functions.messages import MODEL_ROLE, message
from talkloom.functions.text import titled_text
from talkloom.functions.times import parse_ts
from talkloom.operators.lookup import keep_first, lookup
from talkloom.session import materialise

REQUIRED = ("id", "parent_id", "root_id", "author_nick", "created_at")
OPTIONAL = ("content_title", "content_body")
HOPS = 8  # joins of one plan; longer walks are stored in between


def map_threads(df: DataFrame, mapping: Mapping[str, str], ord: str | None = None) -> DataFrame:
    """Rename a forum table's columns; unmapped title or body counts as empty.

    Rows are ordered by creation second, then id. ``ord`` names a column that
    tells rows with the same id apart; without it ids must be unique.
    """
    missing = [key for key in REQUIRED if not mapping.get(key)]
    if missing:
        raise ValueError(f"column mapping lacks {', '.join(missing)}")
    texts = [
        (F.col(mapping[key]).cast("string") if mapping.get(key) in df.columns else F.lit("")).alias(key)
        for key in OPTIONAL
    ]
    created = F.col(mapping["created_at"]).cast("string")
    tie = [F.col(ord)] if ord else []
    return df.select(
        *[F.col(mapping[key]).alias(key) for key in REQUIRED[:4]],
        *texts,
        created.alias("created_at"),
        F.struct(F.date_trunc("second", parse_ts(created)).alias("ts"), F.col(mapping["id"]).alias("id"), *tie).alias(
            "ord"
        ),
    )


def _next(parent: Column, own: Column) -> Column:
    """The parent to walk to, or null at the end of a chain."""
    text = parent.cast("string")
    return F.when((text != "") & (text != "0") & (parent != own), parent)


def nodes_by_id(threads: DataFrame) -> DataFrame:
    """One row per id; of repeated ids the last in order wins, settled before any text moves."""
    last = keep_first(threads.select("id", "ord"), "id", F.desc("ord"))
    kept = lookup(threads.select("ord", "id", "parent_id", "author_nick", "content_title", "content_body"), last, ["id", "ord"], "left_semi")
    return kept.drop("ord")


def _skip_author(nodes: DataFrame, nick: str) -> DataFrame:
    """Point every node at its nearest ancestor by someone else.

    Only the author's own nodes are rewritten, doubling the stride each round.
    """
    own = F.coalesce(F.col("author_nick"), F.lit("")) == nick
    links = nodes.select("id", own.alias("_own"), _next(F.col("parent_id"), F.col("id")).alias("_ptr"))
    links = materialise(links, "thread-links")
    mine = links.where("_own").select("id", "_ptr")
    rounds = mine.count().bit_length() + 1
    for _ in range(rounds):
        step = mine.select(F.col("id").alias("_ptr"), F.col("_ptr").alias("_over"), F.lit(True).alias("_mine"))
        mine = materialise(
            lookup(mine.where(F.col("_ptr").isNotNull()), step, "_ptr")
            .select("id", F.when(F.col("_mine"), F.col("_over")).otherwise(F.col("_ptr")).alias("_ptr"), "_mine")
            .unionByName(mine.where(F.col("_ptr").isNull()).select("id", "_ptr", F.lit(None).cast("boolean").alias("_mine"))),
            "thread-skips",
        )
        moved = not mine.where("_mine").isEmpty()
        mine = mine.select("id", "_ptr")
        if not moved:
            break
    else:
        # Pointers still among the author's own nodes go round in a cycle of them.
        step = mine.select(F.col("id").alias("_ptr"), F.lit(True).alias("_mine"))
        mine = lookup(mine, step, "_ptr").select("id", F.when(F.col("_mine").isNull(), F.col("_ptr")).alias("_ptr"))
    over = mine.select(F.col("id").alias("_ptr"), F.col("_ptr").alias("_over"), F.lit(True).alias("_mine"))
    return lookup(links, over, "_ptr").select(
        "id", F.when(F.col("_mine"), F.col("_over")).otherwise(F.col("_ptr")).alias("parent_id")
    )


def _walk_hops(leaves: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    step = nodes.select(F.col("id").alias("_ptr"), _next(F.col("parent_id"), F.col("id")).alias("_up"))
    step = step.withColumn("_known", F.lit(True))
    walk = leaves.withColumn("_path", F.array("id"))
    for hop in range(hops):
        if hop and hop % HOPS == 0:
            walk = materialise(walk, "thread-walk")
            if walk.where(F.col("_ptr").isNotNull()).isEmpty():
                break
        fresh = F.col("_known") & ~F.array_contains("_path", F.col("_ptr"))
        fresh = F.coalesce(fresh, F.lit(False))
        walk = (
            lookup(walk, step, "_ptr")
            .withColumn("_fresh", fresh)
            .withColumn("_path", F.when(F.col("_fresh"), F.concat("_path", F.array("_ptr"))).otherwise(F.col("_path")))
            .withColumn("_ptr", F.when(F.col("_fresh"), F.col("_up")))
            .drop("_up", "_known", "_fresh")
        )
    return walk.withColumn("_path", F.slice("_path", F.lit(2), F.greatest(F.size("_path"), F.lit(1)))).drop("_ptr")


def _node_walks(nodes: DataFrame) -> DataFrame:
    """``_path`` of every node (itself first, then up), the stride doubling each round."""
    walks = materialise(
        nodes.select(
            "id", F.array("id").alias("_path"), _next(F.col("parent_id"), F.col("id")).alias("_ptr")
        ),
        "thread-walks",
    )
    while not walks.where(F.col("_ptr").isNotNull()).isEmpty():
        step = walks.select(F.col("id").alias("_ptr"), F.col("_path").alias("_more"), F.col("_ptr").alias("_up"))
        known = F.col("_more").isNotNull()
        again = F.arrays_overlap("_path", "_more")
        # A chain that comes back to itself ends before the first node seen twice.
        fresh = F.slice(
            "_more", F.lit(1),
            F.array_position("_more", F.get(F.array_intersect("_more", "_path"), F.lit(0))).cast("int") - 1,
        )
        moved = (
            lookup(walks.where(F.col("_ptr").isNotNull()), step, "_ptr")
            .withColumn(
                "_long",
                F.when(~known, F.col("_path"))
                .when(again, F.concat("_path", fresh))
                .otherwise(F.concat("_path", "_more")),
            )
            .withColumn("_ptr", F.when(known & ~again, F.col("_up")))
            .select("id", F.col("_long").alias("_path"), "_ptr")
        )
        walks = materialise(walks.where(F.col("_ptr").isNull()).unionByName(moved), "thread-walks")
    return walks.select("id", "_path")


def ancestor_paths(leaves: DataFrame, nodes: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``leaves`` (id, ``_ptr``, …) plus ``_path``: ancestor ids, nearest first.

    A walk ends at a missing parent or before a node it has already met.
    """
    if max_hops is not None:
        return _walk_hops(leaves, nodes, max_hops)
    walks = _node_walks(nodes)
    up = walks.select(F.col("id").alias("_ptr"), F.col("_path"))
    before_self = F.array_position("_path", F.col("id")).cast("int")
    path = F.coalesce("_path", F.array().cast(walks.schema["_path"].dataType))
    return (
        lookup(leaves, up, "_ptr")
        .withColumn("_path", path)
        .withColumn("_path", F.when(before_self > 0, F.slice("_path", F.lit(1), before_self - 1)).otherwise(F.col("_path")))
        .drop("_ptr")
    )


def ancestor_chains(threads: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Rows id, chain (root … self) for every thread row."""
    nodes = nodes_by_id(threads)
    leaves = threads.select("id", _next(F.col("parent_id"), F.col("id")).alias("_ptr"))
    return ancestor_paths(leaves, nodes, max_hops).select(
        "id", F.concat(F.reverse("_path"), F.array("id")).alias("chain")
    )


def thread_examples(
    threads: DataFrame, nick: str, max_context: int = 8, strip_self_context: bool = False, role: str = MODEL_ROLE
) -> DataFrame:
    """One example per non-empty reply by ``nick`` that has any context.

    Ids are walked first; texts are fetched once, by an even join on single
    context posts, and gathered per reply.
    """
    if not nick:
        raise ValueError("an author nick is needed")
    is_author = F.coalesce(F.col("author_nick"), F.lit("")) == nick
    text = titled_text(F.col("content_title"), F.col("content_body"))
    nodes = materialise(nodes_by_id(threads), "thread-nodes")
    leaves = threads.where(is_author)
    starts = leaves.select("ord", "id", _next(F.col("parent_id"), F.col("id")).alias("_ptr"))

    links = nodes.select("id", "parent_id")
    if strip_self_context:
        links = materialise(_skip_author(nodes, nick), "thread-others")
        over = links.select(F.col("id").alias("_from"), F.col("parent_id").alias("_over"))
        mine = nodes.where(is_author).select(F.col("id").alias("_from"))
        over = over.join(mine, "_from", "left_semi").select(F.col("_from").alias("_ptr"), "_over", F.lit(True).alias("_mine"))
        starts = lookup(starts, over, "_ptr").select(
            "ord", "id", F.when(F.col("_mine"), F.col("_over")).otherwise(F.col("_ptr")).alias("_ptr")
        )
    paths = ancestor_paths(starts, links, max_context if max_context > 0 else None)
    context = paths.select("ord", F.posexplode("_path").alias("_hop", "id"))
    posts = nodes.select("id", text.alias("_text"))
    gathered = (
        lookup(context, posts, "id", "inner")
        .where(F.col("_text") != "")
        .select("ord", (-F.col("_hop") - 1).alias("_at"), message("user", F.col("_text")).alias("_message"))
    )
    answers = leaves.select(
        "ord", F.lit(0).alias("_at"), message(role, text).alias("_message"), "root_id", "id", "created_at"
    ).where(F.col("_message.content") != "")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_message"))), lambda x: x["_message"])
    return (
        answers.unionByName(gathered, allowMissingColumns=True)
        .groupBy("ord")
        .agg(
            F.max("root_id").alias("thread_id"),
            F.max("id").alias("post_id"),
            F.max("created_at").alias("created_at"),
            in_order.alias("messages"),
            F.max("_at").alias("_last"),
        )
        .where((F.col("_last") == 0) & (F.size("messages") >= 2))
        .drop("_last")
    )
