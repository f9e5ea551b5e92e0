"""The jobs: operators put together, first on DataFrames, then on paths."""

from __future__ import annotations

import logging
from collections.abc import Collection, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from talkloom.functions.messages import MODEL_ROLE, render_chat
from talkloom.operators import documents as docs, posts as post_ops, sync, threads as thread_ops
from talkloom.operators.examples import (
    DEFAULT_KEEP, dedup_examples, drop_generic, keyed_examples, normalize_examples, shuffled, shuffled_first,
)
from talkloom.operators.quality import quality_report, source_composition
from talkloom.operators.ranks import split, tail_split
from talkloom.session import materialise, materialise_all
from talkloom.sources import jsonl
from talkloom.sources.api_pages import PAGE_LOG, landed_pages, list_pages, page_posts, put_aside, rejected_pages
from talkloom.sources.archive import read_post_archive
from talkloom.sources.documents import (
    exactly, extract_text, list_documents, many_files, none_read, path_batches, read_batch,
)
from talkloom.sources.state import (
    append_posts, ledger_ids, load_state, merge_ledger, open_state, publish_changes, publish_state, seed_ledger,
)

SYNC_STATE = "start_time string"

log = logging.getLogger(__name__)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows on their way into a sink, without a pass of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


# --- on DataFrames -----------------------------------------------------------


def import_posts(
    raw_posts: DataFrame, eval_pct: float = 0.0, include_replies: bool = True, no_quotes: bool = False,
    dialog: bool = True, role: str = MODEL_ROLE,
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) examples of a post archive, with ``sort_ts`` and ``ord`` for time order.

    The unified posts are written once, as posts and as parents; so are the
    examples, which the hold-out boundary parts.
    """
    posts = materialise(post_ops.unify_posts(raw_posts), "posts")
    kept = post_ops.dedup_posts(post_ops.filter_posts(posts, include_replies, no_quotes))
    if dialog:
        kept = materialise(kept, "kept-posts")
    rows = post_ops.post_examples(kept, posts, dialog, role=role)
    examples = materialise(
        rows.select(F.col("id_str").alias("tweet_id"), "messages", *post_ops.time_order()), "post-examples")
    return tail_split(examples, [F.col("sort_ts"), F.col("ord")], eval_pct)


def sync_posts(
    feed: DataFrame, existing: DataFrame, mark: str = sync.START_OF_TIME, min_len: int = 10,
    exclude_sources: Collection[str] = (), no_quotes: bool = False, role: str = MODEL_ROLE,
) -> tuple[DataFrame, DataFrame]:
    """(new examples, one-row next mark) for a feed already filtered by the old mark."""
    new = sync.new_posts(feed, existing, min_len=min_len, exclude_sources=exclude_sources, no_quotes=no_quotes)
    new = materialise(new, "new-posts")
    return sync.sync_examples(new, role), sync.next_mark(new, mark)


def import_threads(
    threads: DataFrame, nick: str, max_context: int = 8, strip_self_context: bool = False, role: str = MODEL_ROLE
) -> DataFrame:
    """Examples thread_id, post_id, created_at, messages and ``ord`` (see ``map_threads``)."""
    return thread_ops.thread_examples(threads, nick, max_context, strip_self_context, role)


def import_documents(
    changed: DataFrame, manifest: DataFrame, scanned: DataFrame, min_chars: int = 80, max_chars: int = 1200,
    lang: str = "", delete_missing: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(new examples, next manifest) from changed documents with their text.

    Files without text are left out of the manifest and come up again.
    """
    rows = materialise(docs.split_documents(changed, min_chars, max_chars), "document-chunks")
    return chunk_examples(rows, manifest, lang), docs.next_manifest(manifest, docs.manifest_entries(rows), scanned, delete_missing)


def chunk_examples(rows: DataFrame, manifest: DataFrame, lang: str = "") -> DataFrame:
    """Examples of the paragraphs that the manifest does not hold."""
    chunks = rows.where(F.col("paragraph").isNotNull()).select("path", "pos", "paragraph", "chunk_hash")
    return docs.document_examples(docs.new_chunks(chunks, manifest), lang)


def unify(
    df: DataFrame, keep: Sequence[str] = DEFAULT_KEEP, shuffle: bool = True, seed: int = 42, drop_generic_prompts: bool = False
) -> DataFrame:
    """Normalised, repaired, deduplicated examples, shuffled or in input order."""
    if shuffle:
        return shuffled_first(keyed_examples(normalized_rows(df, keep, drop_generic_prompts)), seed, "dedup_key")
    return ordered(unified_rows(df, keep, drop_generic_prompts), shuffle, seed)


def normalized_rows(df: DataFrame, keep: Sequence[str] = DEFAULT_KEEP, drop_generic_prompts: bool = False) -> DataFrame:
    rows = normalize_examples(df, keep)
    return drop_generic(rows) if drop_generic_prompts else rows


def unified_rows(df: DataFrame, keep: Sequence[str] = DEFAULT_KEEP, drop_generic_prompts: bool = False) -> DataFrame:
    return dedup_examples(normalized_rows(df, keep, drop_generic_prompts))


def ordered(rows: DataFrame, shuffle: bool = True, seed: int = 42) -> DataFrame:
    return shuffled(rows, seed, "dedup_key") if shuffle else rows.orderBy("ord")


def render(df: DataFrame, template: str = "{role}: {content}", separator: str = "\n") -> DataFrame:
    return df.withColumn("text", render_chat(F.col("messages"), template, separator))


# --- on paths ----------------------------------------------------------------


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order).drop(*order)


def _eval_path(path: str) -> str:
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}_eval.{suffix}" if dot and "/" not in suffix else f"{path}_eval"


def run_post_import(spark: SparkSession, archive: str, out: str, **options) -> dict[str, int]:
    train, held_out = import_posts(read_post_archive(spark, archive), **options)
    written = {}
    if train.isEmpty() and held_out.isEmpty():
        return written  # nothing to write leaves the old dataset as it is
    train, seen = counted(_in_order(train, "sort_ts", "ord"), "train")
    jsonl.write_examples(train, out)
    written["train"] = seen.get["rows"]
    if options.get("eval_pct", 0.0) > 0 and not held_out.isEmpty():
        held_out, seen = counted(_in_order(held_out, "sort_ts", "ord"), "eval")
        jsonl.write_examples(held_out, _eval_path(out))
        written["eval"] = seen.get["rows"]
    return written


def run_post_sync(
    spark: SparkSession, pages: str, out: str, state: str, include_replies: bool = True, rejects: str = "", **options
) -> dict[str, int]:
    """Append the new posts of the landed pages; the mark moves only if there were any.

    A malformed page stops the run, unless there is a folder ``rejects``, to which it then goes before the mark moves.
    """
    now, ledger = open_state(spark, state), f"{state}/id-buckets"
    seed_ledger(spark, ledger, out, now.generation)
    merge_ledger(spark, ledger, now.batch)
    saved = load_state(spark, now, SYNC_STATE).first()
    mark = saved.start_time if saved else sync.START_OF_TIME
    # Page files are read once. Their log follows the mark: what a crash keeps out of it is read again.
    log_state = open_state(spark, f"{state}/pages")
    handled, listed = load_state(spark, log_state, PAGE_LOG), materialise(list_pages(spark, pages), "listed-pages")
    fresh = materialise(listed.join(handled, ["path", "mtime", "size"], "left_anti"), "fresh-pages")
    batches = list(path_batches(fresh))
    if not batches:
        return {"appended": 0}
    landed = [landed_pages(spark, [exactly(path) for path in batch], keep_malformed=bool(rejects)) for batch in batches]
    landed = reduce(DataFrame.unionByName, landed)
    if rejects:
        put_aside(rejected_pages(landed), rejects, f"{log_state.batch}")
    feed = page_posts(landed, mark, include_replies)
    known = ledger_ids(spark, ledger, now.batch, among=feed.select(sync.post_id(feed).alias("tweet_id")))
    examples, next_mark = sync_posts(feed, known, mark, **options)
    appended = 0
    if not examples.isEmpty():
        examples, seen = counted(_in_order(examples, "ord"), "appended")
        append_posts(examples, out, ledger, now.batch)
        publish_state(next_mark, now)
        appended = seen.get["rows"]
    gone = handled.join(listed.select("path"), "path", "left_anti").withColumn("gone", F.lit(True))
    publish_changes(fresh.withColumn("gone", F.lit(False)).unionByName(gone), log_state, PAGE_LOG)
    return {"appended": appended}


def run_thread_import(
    threads: DataFrame, mapping: Mapping[str, str], out: str, nick: str, **options
) -> dict[str, int]:
    # Rows with the same id are told apart by their place in the input.
    placed = materialise(threads.withColumn("_place", F.monotonically_increasing_id()), "thread-rows")
    examples = import_threads(thread_ops.map_threads(placed, mapping, ord="_place"), nick, **options)
    examples, seen = counted(_in_order(examples, "ord"), "written")
    jsonl.write_examples(examples, out)
    return {"written": seen.get["rows"]}


def run_document_import(
    spark: SparkSession, root: str, out: str, state: str, min_chars: int = 80, max_chars: int = 1200, lang: str = "",
    delete_missing: bool = False,
) -> dict[str, int]:
    """Append the new paragraphs of changed documents, then publish the manifest.

    Changed files are read in batches, each by a scan of exactly these, and only their paragraphs are kept.
    """
    now = open_state(spark, state)
    manifest = load_state(spark, now, docs.MANIFEST)
    cut = lambda files: docs.split_documents(extract_text(files), min_chars, max_chars)
    with many_files(spark):
        scanned = materialise(list_documents(spark, root), "scanned-documents")
        changed = materialise(docs.changed_files(scanned, manifest), "changed-documents")
        parts = (partial(lambda batch: cut(read_batch(spark, batch)), batch) for batch in path_batches(changed))
        rows = materialise_all(spark, parts, cut(none_read(spark)).schema, "document-chunks")
    examples, seen = counted(_in_order(chunk_examples(rows, manifest, lang), "ord"), "appended")
    jsonl.write_batch(examples, out, now.batch)
    publish_changes(docs.manifest_changes(manifest, docs.manifest_entries(rows), scanned, delete_missing), now, docs.MANIFEST)
    return {"appended": seen.get["rows"]}


def run_unify(
    spark: SparkSession, inputs: Sequence[str], out: str, folder: str = "", keep: Sequence[str] = DEFAULT_KEEP,
    shuffle: bool = True, seed: int = 42, drop_generic_prompts: bool = False, rejects: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Write the unified dataset; returns (quality report, source composition).

    Without ``inputs``, all datasets of ``folder`` but the output and splits. Kept keys come out as the
    JSON text they were. Rejected lines are counted on the way; if there are any, they are written to the
    folder ``rejects``, before the dataset, or else only logged.
    """
    lines = jsonl.read_lines(spark, inputs) if inputs else jsonl.dataset_folder_lines(spark, folder, out)
    raw, seen = [k for k in keep if k != "messages"], Observation("unify")
    rows = jsonl.parse_examples(lines, dict.fromkeys(raw, jsonl.RAW), seen)
    unified = materialise(unified_rows(rows, keep, drop_generic_prompts), "unified")
    if rejected := seen.get["rejected"]:
        log.warning("%d of %d lines are no example and were left out", rejected, seen.get["lines"])
        if rejects:
            jsonl.write_rejects(jsonl.rejected_lines(lines), rejects)
    jsonl.write_raw_examples(ordered(unified, shuffle, seed), out, raw)
    return quality_report(unified), source_composition(unified)


def run_split(
    spark: SparkSession, path: str, train_out: str, eval_out: str, eval_pct: float = 0.05, seed: int = 42
) -> dict[str, int]:
    """Split a dataset; its lines pass through as they are."""
    lines = jsonl.valid_lines(jsonl.read_lines(spark, path))
    if lines.isEmpty():
        return {"train": 0, "eval": 0}  # the old parts stay
    train, held_out = split(lines, "value", eval_pct, seed, tie="ord")
    sizes = {}
    for name, part, out in (("train", train, train_out), ("eval", held_out, eval_out)):
        part, seen = counted(part, name)
        jsonl.write_lines(part, out)
        sizes[name] = seen.get["rows"]
    return sizes


def run_render(spark: SparkSession, path: str, **options) -> DataFrame:
    return render(jsonl.read_examples(spark, path, ()), **options).select("text")
