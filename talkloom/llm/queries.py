"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.llm import bpe, fingerprints, jaccard, language_id, lines, mixing, periodic_runs, quality, token_counts, topk, toxicity, urls, whitening
from talkloom.llm.folds import fold
from talkloom.session import materialise

#: Rows that go to a Python worker at once; texts can be long.
BATCH = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = mixing.describe(table(spark, sf_dir, "documents"))
    mixed = mixing.mix(materialise(described, "described"), keep=mixing.KEEP, bound=mixing.BOUND)
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, ranks = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    trees = materialise(token_counts.build(documents, ranks), "token_trees")
    return token_counts.counts_after(trees, token_counts.scrubbing(documents), ranks)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels, training=fold("doc_id", 5) != 0)
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    scored = toxicity.score(documents.select("doc_id", held_out, "text"), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("version")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(documents, exact_chars=1).select("doc_id", "text", "n_dropped")


RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, urls.page_links(pages))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.fit(documents, training=fold("doc_id", 4) != 2)
    held_out = (fold("doc_id", 4) == 2).alias("held_out")
    found = language_id.predict(documents.select("doc_id", held_out, "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(table(spark, sf_dir, "documents"), stuttering=True))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_mix_weights": op3_mix_weights,
    "op4_topk_search": op4_topk_search,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_fingerprints": op11_fingerprints,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}
