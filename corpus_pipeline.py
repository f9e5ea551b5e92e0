"""The corpus pipeline: the operators of talkloom.llm applied to documents one after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from talkloom.llm.stages import encode, forget, mix, near_duplicates, repeated_lines, toxic
from talkloom.session import shared_folder

STAGES = [
    ("toxicity", toxic),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: The first stage fits a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents after all stages, each stored as Parquet and read again.

    Once a stage's result is stored, its intermediate tables are removed.
    """
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{number}")
        forget(spark)
    return docs
