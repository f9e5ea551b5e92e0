"""The stages of the corpus pipeline: each applies one operator to what its predecessor kept.

All but the last return the columns of ``docs`` as they came, extra ones included, whatever their
names. Null texts count as empty, rows without an id are judged by their text, repeated rows and
empty tables are allowed.

A stage's result is written before the next stage is called with what was written. So a
stage starts by removing the intermediate tables of stages before it, unless ``docs`` still
reads from them. Whoever wants to build a stage upon a result that is not written yet
calls the stage's function without this, its ``__wrapped__``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.llm import bpe, jaccard, lines, mixing, toxicity
from talkloom.llm.folds import fold
from talkloom.llm.queries import table, tokenizer_path
from talkloom.operators.lookup import free_name, lookup
from talkloom.session import drop_folder, materialise, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders of intermediate tables, by application.
_left: dict[str, list[str]] = {}


def forget(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Remove the intermediate tables of the stages called so far, but for those that ``docs`` reads."""
    folders = _left.pop(spark.sparkContext.applicationId, [])
    read = docs.inputFiles() if folders and docs is not None else []
    # Files are listed with their scheme, folders as they were named.
    bare = lambda path: "/" + path.split(":", 1)[-1].lstrip("/")
    kept = [f for f in folders if any(bare(r).startswith(bare(f) + "/") for r in read)]
    for folder in folders:
        if folder not in kept:
            drop_folder(spark, folder)
    if kept:
        _left[spark.sparkContext.applicationId] = kept


def stage(work: Stage) -> Stage:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, docs)
        with scratch(spark, work.__name__) as folder:
            kept = work(spark, docs, sf_dir)
        _left.setdefault(spark.sparkContext.applicationId, []).append(folder)
        return kept

    return run


#: Near copies: documents whose shingles of so many words have so many hundredths in common.
NEAR_WIDTH, NEAR_PER_CENT = 5, 80


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; those without text stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), training=fold("doc_id", 5) != 0)
    score = free_name("_score", docs)
    return toxicity.score(docs, model, into=score).where(F.col(score) < 0.5).select(*docs.columns)


@stage
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those of which no word is left go.

    Lines of any length go where they equal an earlier one.
    Where lines were taken out, ``n_chars`` is the length of the rest.
    """
    dropped = free_name("_dropped", docs)
    changed = lines.dedup(docs, dropped=dropped, exact_chars=1)
    rest = changed.where((F.col(dropped) == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    size = F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")) \
        if "n_chars" in docs.columns else None
    return rest.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Rows without an id stay."""
    key = [free_name("_doc", docs), free_name("_version", docs)]
    first, rows = free_name("_first", docs), free_name("_n", docs)
    joined = jaccard.join(docs, width=NEAR_WIDTH, per_cent=NEAR_PER_CENT).where("doc_id IS NOT NULL")
    # Only what is not first in its group, or there more than once, has to be looked up.
    judged = joined.groupBy(F.col("doc_id").alias(key[0]), F.coalesce("version", F.lit(0)).alias(key[1])).agg(
        (F.min("component_id") == F.first("doc_id")).alias(first), F.count("*").alias(rows)).where(~F.col(first) | (F.col(rows) > 1))
    keyed = docs.withColumn(key[0], F.col("doc_id").cast("long")).withColumn(key[1], F.coalesce(F.xxhash64("text"), F.lit(0)))
    found = lookup(keyed, materialise(judged, "near_duplicates"), key)
    alone = found.where(F.col(first).isNull())
    # The same id and text several times: one row stays.
    repeated = found.where(F.col(first)).dropDuplicates(key)
    return alone.unionByName(repeated).select(*docs.columns)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents, ``mixing.KEEP`` of their tokens, as near to the raked source, language and topic shares as their cells allow.

    A document's id decides its draw; rows without one are drawn together.
    """
    dimensions = ["source", "lang", "topic"]
    rated = mixing.rates(materialise(mixing.describe(docs), "described"), dimensions, keep=mixing.KEEP, bound=mixing.BOUND)
    named, share = [free_name(f"_{d}", docs) for d in dimensions], free_name("_p", docs)
    marked = mixing.with_cells(docs, named)
    chosen = lookup(marked, rated.select(*[F.col(d).alias(n) for d, n in zip(dimensions, named)], F.col("probability").alias(share)), named)
    return chosen.where(mixing.uniform(F.col("doc_id"), "mix") < F.col(share)).select(*docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of each row; a null text has no tokens."""
    encoded = bpe.encode(docs, tokenizer_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
