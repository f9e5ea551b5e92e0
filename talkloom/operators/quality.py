"""Dataset quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkloom.functions.messages import has_generic_prompt, is_generic_prompt, user_turns

GENERIC_WARNING_SHARE = 0.5


def _chars(messages):
    return F.aggregate(messages, F.lit(0).cast("bigint"), lambda n, m: n + F.length(m["content"]))


def example_measures(df: DataFrame) -> DataFrame:
    """User turns, generic flag and text lengths per example row."""
    m = F.col("messages")
    answers = F.filter(m, lambda x: x["role"] == "assistant")
    source = F.coalesce(F.col("source_file"), F.lit("unknown")) if "source_file" in df.columns else F.lit("unknown")
    return df.select(
        source.alias("source_file"),
        F.size(user_turns(m)).alias("user_turns"),
        has_generic_prompt(m).alias("generic"),
        _chars(user_turns(m)).alias("prompt_chars"),
        _chars(answers).alias("response_chars"),
    )


def turn_measures(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The same measures from a table with one row per message."""
    is_user, is_answer = F.col("role") == "user", F.col("role") == "assistant"
    chars = F.length("content")
    return turns.groupBy(conv).agg(
        F.count_if(is_user).cast("int").alias("user_turns"),
        F.coalesce(
            F.max_by(is_generic_prompt(F.col("content")), F.when(is_user, F.col("turn"))), F.lit(False)
        ).alias("generic"),
        F.coalesce(F.sum(F.when(is_user, chars)), F.lit(0)).alias("prompt_chars"),
        F.coalesce(F.sum(F.when(is_answer, chars)), F.lit(0)).alias("response_chars"),
    )


def report(measures: DataFrame) -> DataFrame:
    """One row of totals, shares and averages; no row for an empty dataset."""
    total = F.count(F.lit(1))
    single = F.count_if(F.col("user_turns") == 1)
    generic_share = F.count_if("generic") / total
    return (
        measures.agg(
            total.alias("total_examples"),
            (single / total).alias("single_turn_pct"),
            ((total - single) / total).alias("multi_turn_pct"),
            generic_share.alias("generic_prompt_pct"),
            (F.sum("prompt_chars") / total).alias("avg_prompt_len"),
            (F.sum("response_chars") / total).alias("avg_response_len"),
            (generic_share > GENERIC_WARNING_SHARE).alias("generic_warning"),
        )
        .where("total_examples > 0")
    )


def quality_report(df: DataFrame) -> DataFrame:
    return report(example_measures(df))


def source_composition(df: DataFrame) -> DataFrame:
    """Share of rows per source."""
    source = F.coalesce(F.col("source_file"), F.lit("unknown")).alias("source_file")
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("examples"))
    total = counts.agg(F.sum("examples")).scalar()
    return counts.withColumn("share", F.col("examples") / total)


def turn_histogram(measures: DataFrame) -> DataFrame:
    """Examples by number of user turns."""
    return measures.groupBy("user_turns").agg(F.count(F.lit(1)).alias("examples"))
