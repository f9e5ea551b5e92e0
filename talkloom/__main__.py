"""Command line: ``spark-submit … talkloom/__main__.py <job> …`` or ``python -m talkloom <job> …``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from talkloom.plans import jobs
from talkloom.session import build_session
from talkloom.sources.sqlite import read_sqlite
from talkloom.streaming.sync import start_post_sync


def thread_mapping(text: str) -> tuple[str, dict[str, str]]:
    """Table name and column mapping from a JSON or YAML description."""
    try:
        config = json.loads(text)
    except ValueError:
        import yaml  # only needed for YAML descriptions

        config = yaml.safe_load(text)
    schema = config.get("schema_mapping") or {}
    table, columns = schema.get("table_name"), schema.get("column_names")
    if not table or not columns:
        raise SystemExit("the mapping file needs schema_mapping.table_name and schema_mapping.column_names")
    return table, columns


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="talkloom")
    jobs_of = top.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = jobs_of.add_parser(name)
        for path in paths:
            sub.add_argument(path)
        return sub

    def flag(sub, name: str, default: bool) -> None:
        sub.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default)

    posts = job("posts-import", "archive", "out")
    posts.add_argument("--eval-pct", type=float, default=0.0)
    sync = job("posts-sync", "pages", "out", "state")
    sync.add_argument("--min-len", type=int, default=10)
    sync.add_argument("--exclude-sources", default="")
    sync.add_argument("--checkpoint", help="run as a stream with this checkpoint folder")
    for sub in (posts, sync):
        flag(sub, "include-replies", True)
        flag(sub, "no-quotes", False)
    flag(posts, "dialog", True)
    sql = job("sql-import", "source", "out")
    sql.add_argument("--mapping", required=True, help="JSON or YAML file with schema_mapping")
    sql.add_argument("--nick", required=True)
    sql.add_argument("--max-context", type=int, default=8)
    flag(sql, "strip-self-context", False)
    for sub in (posts, sync, sql):
        sub.add_argument("--role", default="model")
    docs = job("docs-import", "root", "out", "state")
    docs.add_argument("--min-chars", type=int, default=80)
    docs.add_argument("--max-chars", type=int, default=1200)
    docs.add_argument("--lang", default="")
    flag(docs, "delete-missing", False)
    unify = job("unify", "out")
    unify.add_argument("--in", dest="inputs", action="append", default=[])
    unify.add_argument("--folder", default="dataset")
    unify.add_argument("--keep", default="messages,created_at")
    flag(unify, "shuffle", True)
    flag(unify, "drop-generic-prompts", False)
    split = job("split-eval", "path", "train_out", "eval_out")
    split.add_argument("--eval-pct", type=float, default=0.05)
    for sub in (unify, split):
        sub.add_argument("--seed", type=int, default=42)
    render = job("render", "path", "out")
    render.add_argument("--template", default="{role}: {content}")
    render.add_argument("--separator", default="\n")
    return top


def run(spark: SparkSession, arguments: Sequence[str] | None = None) -> None:
    options = vars(parser().parse_args(arguments))
    name = options.pop("job")
    if name == "posts-import":
        print(jobs.run_post_import(spark, options.pop("archive"), options.pop("out"), **options))
    elif name == "posts-sync":
        options["exclude_sources"] = {s.strip() for s in options["exclude_sources"].split(",") if s.strip()}
        pages, out, state = (options.pop(key) for key in ("pages", "out", "state"))
        if checkpoint := options.pop("checkpoint"):
            start_post_sync(spark, pages, out, state, checkpoint, **options).awaitTermination()
        else:
            print(jobs.run_post_sync(spark, pages, out, state, **options))
    elif name == "sql-import":
        mapping = spark.read.text(options.pop("mapping"), wholetext=True).first()[0]
        table, columns = thread_mapping(mapping)
        source = options.pop("source")
        if source.endswith((".db", ".sqlite", ".sqlite3")):
            rows = read_sqlite(spark, source, table)
        else:
            rows = spark.read.parquet(source)
        print(jobs.run_thread_import(rows, columns, options.pop("out"), **options))
    elif name == "docs-import":
        print(jobs.run_document_import(spark, options.pop("root"), options.pop("out"), options.pop("state"), **options))
    elif name == "unify":
        options["keep"] = [key.strip() for key in options["keep"].split(",")]
        report, shares = jobs.run_unify(spark, options.pop("inputs"), options.pop("out"), **options)
        report.show(truncate=False)
        shares.orderBy("source_file").show(truncate=False)
    elif name == "split-eval":
        print(jobs.run_split(spark, **options))
    else:
        path, out = options.pop("path"), options.pop("out")
        jobs.run_render(spark, path, **options).write.mode("overwrite").json(out)


if __name__ == "__main__":
    run(build_session())
