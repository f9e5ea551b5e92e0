"""Posts, forum tables, documents and dialogs derived by Spark from the given tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.functions.messages import message
from talkloom.operators.threads import map_threads

EPOCH_2020 = 1577836800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iso(at: Column, form: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    return F.date_format(at, form)


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as archive posts: decorated texts, replies, quotes, reposts, five time formats."""
    doc = F.col("doc_id")
    at = F.timestamp_seconds(EPOCH_2020 + (doc * 37 % 1000) * 3660)
    created = (
        F.when(doc % 13 == 0, F.lit(None))
        .when(doc % 5 == 0, F.concat(F.date_format(at, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(at, "yyyy")))
        .when(doc % 5 == 1, _iso(at))
        .when(doc % 5 == 2, _iso(at, "yyyy-MM-dd HH:mm:ss"))
        .when(doc % 5 == 3, F.concat(_iso(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit("+0200")))
        .otherwise(_iso(at, "yyyy-MM-dd"))
    )
    text = F.concat(
        F.when(doc % 17 == 3, F.lit("RT @ ")).otherwise(F.lit("")),
        F.lit("@user_"), (doc % 9).cast("string"), F.lit(" "), F.col("text"),
        F.lit(" https://t.example/"), doc.cast("string"), F.lit("?a=1&b=2 #Tag"), (doc % 10).cast("string"),
        F.when(doc % 4 == 1, F.lit(" &amp;lt;caf&eacute;&gt; &copy")).otherwise(F.lit("")),
        F.when(doc % 19 == 2, F.lit("\nThis tweet was edited at 10:00")).otherwise(F.lit("")),
    )
    return table(spark, sf_dir, "documents").select(
        doc.cast("string").alias("id_str"),
        F.when(doc % 2 == 0, text).alias("full_text"),
        F.when(doc % 2 == 1, text).alias("text"),
        created.alias("created_at"),
        "lang",
        F.concat(F.lit('<a href="https://apps.example/'), F.col("source"), F.lit('" rel="nofollow">'),
                 F.col("source"), F.lit(" &amp; Co</a>")).alias("source"),
        F.when(doc % 3 == 1, (doc - 1).cast("string"))
        .when(doc % 11 == 5, F.lit("none-such")).alias("in_reply_to_status_id_str"),
        (doc % 7 == 0).alias("is_quote_status"),
        doc.alias("ord"),
    )


def thread_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a forum table: chains within and across threads, cycles, self-loops."""
    conv, turn = F.col("conv_id"), F.col("turn")
    own = conv * 100 + turn + 1
    parent = (
        F.when(turn > 0, own - 1)
        .when(conv % 11 == 4, own)
        .when(conv % 7 == 3, own + 1)
        .when(conv % 5 == 1, (conv - 1) * 100 + 1)
        .when(conv % 13 == 6, F.lit(-1))
        .otherwise(F.lit(0))
    )
    day = F.date_format(F.timestamp_seconds(EPOCH_2020 + conv * 86400 + turn * 60), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "conversations").select(
        own.alias("msg_id"), parent.alias("reply_to"), (conv * 100 + 1).alias("thread"), F.col("role").alias("nick"),
        F.when(turn == 0, F.concat(F.lit("Thread "), conv.cast("string"))).alias("subject"),
        F.when((turn == 2) & (conv % 3 == 0), F.lit(" ")).otherwise(F.col("text")).alias("body"), day.alias("posted"),
    )


THREAD_COLUMNS = {
    "id": "msg_id", "parent_id": "reply_to", "root_id": "thread", "author_nick": "nick",
    "content_title": "subject", "content_body": "body", "created_at": "posted",
}


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_threads(thread_table(spark, sf_dir), THREAD_COLUMNS)


def turn_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations six times over: as is, without a turn, other roles, reposts, odd names and blanks."""
    v, turn, role, text = F.col("v"), F.col("turn"), F.col("role"), F.col("text")
    variants = table(spark, sf_dir, "conversations").withColumn("v", F.explode(F.array(*[F.lit(i) for i in range(6)])))
    rotated = F.when(role == "user", "assistant").when(role == "assistant", "system").otherwise("user")
    odd = F.when(role == "user", " Model ").when(role == "assistant", "BOT").otherwise("System")
    return variants.where(~((v == 1) & (turn == 0)) & ~((v == 2) & (turn == 1))).select(
        (F.col("conv_id") * 10 + v).alias("conv_id"),
        "turn",
        F.when(v == 3, rotated).when(v == 5, odd).otherwise(role).alias("role"),
        F.when(v == 4, F.concat(F.lit("<b>RT</b> "), text))
        .when((v == 5) & (turn == 2), F.lit(""))
        .when((v == 5) & (turn % 2 == 1), F.lit(" <p> "))
        .otherwise(text).alias("content"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files with a listing: path, mtime, size, text."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"),
        F.timestamp_seconds(EPOCH_2020 + F.col("doc_id") * 60).alias("mtime"),
        F.col("n_chars").alias("size"),
        "text",
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as HTML files: path, content."""
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/web/page-"), F.col("page_id"), F.lit(".HTML")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )


def latin1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as plain text files in Latin-1, not valid UTF-8 once a text has accents."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/old/doc-"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.encode("text", "ISO-8859-1").alias("content"),
    )


def feed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as API posts; one id per user and day, so ids repeat."""
    user, at = F.col("user_id"), F.col("ts")
    return table(spark, sf_dir, "events").select(
        F.concat(user.cast("string"), F.lit("-"), F.date_format(at, "yyyyMMdd")).alias("id"),
        F.concat("event_type", F.lit(" "), "props", F.lit(" by @user"), user.cast("string")).alias("text"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
        F.col("event_type").alias("source"),
        F.lit("en").alias("lang"),
        F.when(user % 10 == 0, F.array(F.struct(F.lit("quoted").alias("type"), F.lit("1").alias("id"))))
        .when(user % 10 == 1, F.array(F.struct(F.lit("replied_to").alias("type"), F.lit("2").alias("id"))))
        .when(user % 10 == 2, F.array(F.struct(F.lit("retweeted").alias("type"), F.lit("3").alias("id"))))
        .alias("referenced_tweets"),
        F.col("event_id").alias("ord"),
    )


def answers_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one-answer dialogs; many texts occur more than once."""
    return table(spark, sf_dir, "documents").select(
        F.array(message("user", F.concat(F.lit("Say it like "), F.col("source"))), message("model", F.col("text"))).alias("messages"),
        "lang",
        F.col("source").alias("source_file"),
        F.col("doc_id").alias("ord"),
    )


def _writer(folder: str):
    """Rows (name, content) to files below the folder, in whatever store it is."""

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                path = f"{base}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                if name.endswith(".docx"):
                    content = docx(content.decode())
                with store.open_output_stream(path) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["written"])

    return write


def docx(text: str) -> bytes:
    """A document with one paragraph per line."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{lines}</w:body></w:document>')
    return packed.getvalue()


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row (name, content as text) as a file of its own; returns how many."""
    rows = files.where(F.col("content").isNotNull()).select("name", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(_writer(folder), "written long").agg(F.sum("written")).first()[0] or 0
