"""Post API responses landed as JSON files, one page per line (or per file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.operators.sync import references, since
from talkloom.sources.jsonl import NO_LIMITS, file_path

#: Page files that were read, as they were then.
PAGE_LOG = "path string, mtime timestamp, size bigint"
# Shape of a response page.
PAGE = (
    "data array<struct<id:string,text:string,created_at:string,source:string,lang:string,"
    "referenced_tweets:array<struct<type:string,id:string>>>>, meta struct<next_token:string>"
)


def list_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime and size of the landed page files, which are not opened; empty files are left out."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def landed_pages(
    spark: SparkSession, path: str | list[str], streaming: bool = False, multiline: bool = False, keep_malformed: bool = False
) -> DataFrame:
    """Raw pages; as a stream, each new file is delivered once.

    A malformed page stops the run: were it passed over, the mark would move beyond its posts. With
    ``keep_malformed`` it comes as a page without data, its text as ``malformed``, for :func:`rejected_pages`.
    """
    reader = (spark.readStream if streaming else spark.read).options(multiLine=multiline, **NO_LIMITS)
    if keep_malformed:
        reader = reader.schema(f"{PAGE}, malformed string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="malformed")
    else:
        reader = reader.schema(PAGE).options(mode="FAILFAST")
    pages = reader.json(path)
    kept = ["malformed"] if keep_malformed else []
    return pages.select("data", "meta", *kept, file_path().alias("file"), F.col("_metadata.file_block_start").alias("block"))


def rejected_pages(pages: DataFrame) -> DataFrame:
    """file, block, reason and value of malformed pages."""
    # The parser refuses to read the malformed text alone.
    return pages.where(F.col("malformed").isNotNull() & (F.col("data").isNull() | F.col("data").isNotNull())).select(
        "file", "block", F.lit("malformed").alias("reason"), F.col("malformed").alias("value"))


def put_aside(rejects: DataFrame, path: str, batch_id: str) -> None:
    """Write a batch's rejects, if there are any; the same batch again replaces them."""
    if not rejects.isEmpty():
        rejects.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def page_posts(pages: DataFrame, start_time: str | None = None, include_replies: bool = True) -> DataFrame:
    """Posts of the pages with ``ord``, filtered as the service would have.

    Reposts never come; replies only if wanted; nothing before ``start_time``.
    """
    if "malformed" in pages.columns:
        # A page that is cut off may have given some posts already; it counts as a whole.
        pages = pages.where(F.col("malformed").isNull())
    posts = (
        pages.withColumn("row", F.monotonically_increasing_id())
        .select("file", "block", "row", F.posexplode("data").alias("pos", "post"))
        .select("post.*", F.struct("file", "block", "row", "pos").alias("ord"))
    )
    left_out = ("retweeted",) if include_replies else ("retweeted", "replied_to")
    return since(posts.where(~references(posts, *left_out)), start_time)


def read_api_pages(
    spark: SparkSession, path: str, start_time: str | None = None, include_replies: bool = True, multiline: bool = False
) -> DataFrame:
    return page_posts(landed_pages(spark, path, multiline=multiline), start_time, include_replies)
