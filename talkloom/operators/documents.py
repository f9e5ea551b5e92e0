"""Documents: paragraphs, change detection and the manifest of past runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkloom.functions.messages import MODEL_ROLE, paragraph_prompt, style_example
from talkloom.functions.text import chunk_hash, norm_ws, paragraphs, topic_words
from talkloom.operators.lookup import lookup
from talkloom.operators.once import compute_once

MANIFEST = "path string, mtime timestamp, size bigint, chunks array<string>"


def split_documents(docs: DataFrame, min_chars: int = 80, max_chars: int = 1200, separator: str | None = None) -> DataFrame:
    """Paragraphs of the wanted length per document, plus their hashes.

    Keeps path, mtime and size. A document without such paragraphs keeps one
    row with a null paragraph, so that the manifest can record it.
    """
    parts = paragraphs(F.col("_text"), separator) if separator else paragraphs(F.col("_text"))
    indexed = F.transform(parts, lambda p, i: F.struct(i.alias("pos"), p.alias("paragraph")))
    fitting = F.filter(indexed, lambda x: F.length(x["paragraph"]).between(min_chars, max_chars))
    carried = [c for c in ("path", "mtime", "size") if c in docs.columns]
    tidied = compute_once(docs.where(F.col("text") != ""), "_text", norm_ws(F.col("text")))
    return (
        tidied.select(*carried, F.explode_outer(fitting).alias("_part"))
        .select(*carried, "_part.pos", "_part.paragraph")
        .withColumn("chunk_hash", F.when(F.col("paragraph").isNotNull(), chunk_hash(F.col("paragraph"))))
    )


def document_chunks(docs: DataFrame, min_chars: int = 80, max_chars: int = 1200, separator: str | None = None) -> DataFrame:
    """Rows path, pos, paragraph, chunk_hash."""
    rows = split_documents(docs, min_chars, max_chars, separator)
    return rows.where(F.col("paragraph").isNotNull()).select("path", "pos", "paragraph", "chunk_hash")


def document_examples(chunks: DataFrame, lang: str = "") -> DataFrame:
    """Examples source, lang, messages; the prompt lists the paragraph's topic words."""
    prompt = paragraph_prompt(topic_words(F.col("paragraph")))
    order = [F.struct("path", "pos").alias("ord")]
    return chunks.select(
        F.col("path").alias("source"),
        F.lit(lang).alias("lang"),
        style_example(F.col("paragraph"), prompt, MODEL_ROLE).alias("messages"),
        *order,
    )


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) the manifest does not hold."""
    return files.join(manifest.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def new_chunks(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks not in their own file's previous chunk list; repeats within this run stay."""
    known = manifest.select("path", F.explode("chunks").alias("chunk_hash")).distinct()
    return lookup(chunks, known, ["path", "chunk_hash"], "left_anti")


def manifest_entries(rows: DataFrame) -> DataFrame:
    """Manifest rows of the processed files (output of ``split_documents``)."""
    return rows.groupBy("path", "mtime", "size").agg(
        F.sort_array(F.collect_set("chunk_hash")).alias("chunks")
    )


def prune_manifest(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """Manifest rows whose file was seen in this scan."""
    return manifest.join(scanned.select("path"), "path", "left_semi")


def next_manifest(
    manifest: DataFrame, entries: DataFrame, scanned: DataFrame, delete_missing: bool = False
) -> DataFrame:
    """Old rows replaced by the new entries, optionally without vanished files."""
    merged = manifest.join(entries.select("path"), "path", "left_anti").unionByName(entries)
    return prune_manifest(merged, scanned) if delete_missing else merged


def manifest_changes(
    manifest: DataFrame, entries: DataFrame, scanned: DataFrame, delete_missing: bool = False
) -> DataFrame:
    """What turns the manifest into :func:`next_manifest`: the new entries and, with gone, files that are no more."""
    changes = entries.withColumn("gone", F.lit(False))
    if not delete_missing:
        return changes
    # An entry of a file that vanished meanwhile is old news too.
    seen = changes.join(scanned.select("path"), "path", "left_semi")
    missing = manifest.join(scanned.select("path"), "path", "left_anti")
    return seen.unionByName(missing.withColumn("gone", F.lit(True)))
