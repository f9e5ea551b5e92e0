"""The dialog operators on a table with one row per message.

Same rules as ``examples``, for dialogs that arrive as rows and may be long.
Every window is over a bounded block of turns; what crosses block borders is a
summary row per block, so a huge dialog is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from talkloom.functions.messages import PLACEHOLDER_PROMPT, REPOST_PREFIX, is_model_role, map_role
from talkloom.functions.text import norm_text, strip
from talkloom.operators.lookup import lookup
from talkloom.operators.once import compute_once

BLOCK = 4096


def clean_turns(df: DataFrame) -> DataFrame:
    """Drop empty messages, map roles, normalise texts, mark texts that begin like a repost.

    Later steps read the result more than once; write it first (``materialise``).
    """
    filled = df.where(F.coalesce(F.col("content"), F.lit("")) != "")
    mapped = filled.select("conv_id", "turn", map_role(F.col("role")).alias("role"), "content")
    cleaned = compute_once(mapped, "content", norm_text(F.col("content")))
    return cleaned.withColumn("repost", F.startswith(F.lower("content"), F.lit(REPOST_PREFIX)))


def merge_turns(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Merge same-role runs: one row per run, ``turn`` being its first turn.

    Adds ``prev_role`` (role of the run before) and ``repost`` (the mark of the
    run's last message).
    """
    if "repost" not in df.columns:
        df = df.withColumn("repost", F.lit(False))
    rows = df.withColumn("_block", F.floor(F.col("turn") / block))
    in_block = Window.partitionBy("conv_id", "_block").orderBy("turn")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("role").over(in_block)
    rows = (
        rows.withColumn("_before", before)
        .withColumn("_start", F.when(F.col("_before") != F.col("role"), F.col("turn")))
        .withColumn("_run", F.max("_start").over(so_far))
    )

    blocks = rows.groupBy("conv_id", "_block").agg(
        F.min_by("role", "turn").alias("_first_role"),
        F.min("turn").alias("_first_turn"),
        F.max_by("role", "turn").alias("_last_role"),
        F.max("_start").alias("_last_start"),
    )
    by_block = Window.partitionBy("conv_id").orderBy("_block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("_entry_role", F.lag("_last_role").over(by_block))
        .withColumn(
            "_head",
            F.when(F.coalesce(F.col("_entry_role") != F.col("_first_role"), F.lit(True)), F.col("_first_turn")),
        )
        .withColumn("_tail", F.coalesce("_last_start", "_head"))
        .withColumn("_entry_run", F.coalesce("_head", F.last("_tail", ignorenulls=True).over(earlier)))
        .select("conv_id", "_block", "_entry_role", "_entry_run")
    )

    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"])
    several = F.count(F.lit(1)) > 1
    merged = strip(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n"))
    return (
        rows.join(blocks, ["conv_id", "_block"])
        .withColumn("_run", F.coalesce("_run", "_entry_run"))
        .withColumn("_before", F.coalesce("_before", "_entry_role"))
        .groupBy("conv_id", F.col("_run").alias("turn"))
        .agg(
            F.min_by("role", "turn").alias("role"),
            F.when(several, merged).otherwise(F.get(texts, F.lit(0))).alias("content"),
            F.min_by("_before", "turn").alias("prev_role"),
            F.max_by("repost", "turn").alias("repost"),
        )
    )


def dialog_verdicts(runs: DataFrame) -> DataFrame:
    """Per kept dialog: the turn of a missing opening prompt, the turn of a dropped last run.

    Decided from counts and edge roles, which Spark aggregates partially, so
    that no dialog has to be gathered. Neighbouring runs differ in role. What is
    left without a leading system run and a trailing non-answer alternates
    exactly when it holds no system run, ends with the assistant and, with a
    missing prompt supplied, is even.
    """
    edges = runs.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("role") == "system").alias("systems"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by(F.struct("role", "prev_role", "repost"), "turn").alias("last"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
    )
    as_int = lambda c: c.cast("int")
    no_prompt = F.col("first_role") == "assistant"
    trailing = F.col("last.role") != "assistant"
    leading_system = (F.col("first_role") == "system") & ((F.col("runs") > 1) | ~trailing)
    rest = F.col("runs") + as_int(no_prompt) - as_int(trailing) - as_int(leading_system)
    inner_systems = F.col("systems") - as_int(leading_system) - as_int(F.col("last.role") == "system")
    closing = F.when(trailing, F.col("last.prev_role")).otherwise(F.col("last.role"))
    keep = (rest > 0) & (rest % 2 == 0) & (inner_systems == 0) & (closing == "assistant")
    is_repost = ~trailing & F.col("last.repost")
    return edges.where(keep & ~is_repost).select(
        "conv_id",
        F.when(no_prompt, F.col("first_turn") - 1).alias("_prompt_turn"),
        F.when(trailing, F.col("last_turn")).alias("_dropped_turn"),
    )


def repair_turns(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Repaired dialogs as rows conv_id, turn, role, content.

    A supplied opening prompt gets the turn before the first one.
    """
    runs = merge_turns(df, block)
    verdicts = dialog_verdicts(runs)
    kept = lookup(runs, verdicts, "conv_id", "inner").where(
        F.col("_dropped_turn").isNull() | (F.col("turn") != F.col("_dropped_turn"))
    )
    prompts = verdicts.where(F.col("_prompt_turn").isNotNull()).select(
        "conv_id",
        F.col("_prompt_turn").alias("turn"),
        F.lit("user").alias("role"),
        F.lit(PLACEHOLDER_PROMPT).alias("content"),
    )
    return kept.select("conv_id", "turn", "role", "content").union(prompts)


def turn_keys(turns: DataFrame) -> DataFrame:
    """conv_id and dialog key (last assistant text) of repaired dialogs."""
    answer = F.max_by("content", F.when(is_model_role(F.col("role")), F.col("turn")))
    last = turns.groupBy("conv_id").agg(answer.alias("_answer"))
    return last.select("conv_id", F.sha2(F.lower(norm_text(F.col("_answer"))), 256).alias("dedup_key"))
