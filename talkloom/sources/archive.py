"""Post archives: script files that assign a JSON array of posts.

A file's array is cut into its items block by block, however large it is. Spark's text
reader gives each block the pieces, ended by ``}``, that begin in it. What a block does to a
reader's state (before the array, outside of strings, in a string, behind a
backslash; and the depth of brackets) is found for each state it may start in. These effects are
put together along each file, one row per block, and tell where each block starts.
Then every block cuts its own items. Items that reach over a block's border leave fragments,
at most two per block, which are put together afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkloom.operators.posts import RAW_POST
from talkloom.session import materialise
from talkloom.sources.jsonl import NO_LIMITS, file_path

# Where an archive keeps its posts.
ARCHIVE_FILES = "data/{tweets.js,tweets/*.js}"

BEFORE, OUTSIDE, STRING, ESCAPED = range(4)
_BLANK = b" \t\r\n"
#: What is left of an array behind its last item, or of an empty one.
CLOSING = re.compile(rb"\[?[ \t\r\n]*\]")


def archive_pattern(path: str) -> str:
    """A single script file, or the post files below an archive folder."""
    if path.lower().endswith(".js"):
        return path
    return f"{path.rstrip('/')}/{ARCHIVE_FILES}"


class State(NamedTuple):
    """Where a reader is; the depth counts from the array's own bracket on."""

    mode: int = BEFORE
    depth: int = 0


def advance(data: bytes, state: State) -> tuple[State, np.ndarray, int]:
    """The state behind ``data``, the places behind each item's end, and that behind the array's (-1: not here)."""
    nothing = np.zeros(0, dtype=np.int64)
    mode, start = state.mode, 0
    if mode == BEFORE:
        start = data.find(b"[")
        if start < 0:
            return state, nothing, -1
        mode = OUTSIDE
    elif mode == ESCAPED and data:
        mode, start = STRING, 1
    text = np.frombuffer(data, dtype=np.uint8)[start:]
    if not len(text):
        return State(mode, state.depth), nothing, -1
    # The last place up to each one that is no backslash: an odd number of them in between escapes.
    plain = np.maximum.accumulate(np.where(text != ord("\\"), np.arange(len(text)), -1))
    quotes = np.flatnonzero(text == ord('"'))
    before = np.where(quotes > 0, plain[quotes - 1], -1)
    quotes = quotes[(quotes - 1 - before) % 2 == 0]
    opens, closes = (text == ord("{")) | (text == ord("[")), (text == ord("}")) | (text == ord("]"))
    brackets = np.flatnonzero(opens | closes)
    brackets = brackets[(np.searchsorted(quotes, brackets) + (mode == STRING)) % 2 == 0]
    depth = state.depth + np.cumsum(np.where(opens[brackets], 1, -1))
    ends = brackets[(text[brackets] == ord("}")) & (depth == 1)] + start + 1
    closed = brackets[depth == 0]
    inside = (len(quotes) + (mode == STRING)) % 2
    escaped = inside and (len(text) - 1 - plain[-1]) % 2
    after = State(ESCAPED if escaped else STRING if inside else OUTSIDE, int(depth[-1]) if len(depth) else state.depth)
    return after, ends, int(closed[0]) + start + 1 if len(closed) else -1


def _pieces(spark: SparkSession, pattern: str) -> DataFrame:
    """path, block (its first byte) and value, a piece without its closing brace."""
    return spark.read.text(pattern, lineSep="}").select(
        file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, bool]]:
    """Key (path, block), bytes and whether the block ends there, for each stretch of a block in a batch.

    A file's last piece gets a brace too. What is behind the array does not count, so that this does no harm.
    """
    held = None
    for batch in batches:
        keys = list(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()))
        values = batch.column("value").to_pylist()
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                if held is not None:
                    yield *held, held[0] != keys[begin]
                held = keys[begin], b"".join(v + b"}" for v in values[begin:i])
                begin = i
    if held is not None:
        yield *held, True


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to one row per block: for each mode it may start in, the mode and the change of depth behind it."""
    starts = [State(mode) for mode in range(4)]
    states = starts
    for key, data, ends in _blocks(batches):
        states = [advance(data, s)[0] for s in states]
        if ends:
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0]]), pa.array([key[1]], pa.int64()),
                pa.array([[s.mode for s in states]], pa.list_(pa.int32())), pa.array([[s.depth for s in states]], pa.list_(pa.int64())),
            ], names=["path", "block", "modes", "depths"])
            states = starts


def _along(effects: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a file with the state each starts in; a file without a whole array is an error."""
    rows, state = [], State()
    for row in effects.sort_values("block").itertuples():
        rows.append((row.path, row.block, state.mode, state.depth))
        state = State(int(row.modes[state.mode]), state.depth + int(row.depths[state.mode]))
    # The brace behind the last piece may have gone below.
    if state.mode != OUTSIDE or state.depth not in (0, -1):
        raise ValueError(f"MALFORMED archive, no whole array: {rows[0][0]}")
    return pd.DataFrame(rows, columns=["path", "block", "mode", "depth"])


def _items(states):
    """Pieces to path, block, pos, kind and text: whole items, and the fragments (head, middle, tail) at a block's borders."""

    def rows_of(key: tuple[str, int], parts: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"path": key[0], "block": key[1], "pos": pos, "kind": kind, "text": text} for kind, pos, text in parts],
            pa.schema([("path", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("kind", pa.string()), ("text", pa.binary())]))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rest, pos, open_, begun = None, b"", 0, True, False
        for key, data, ends in _blocks(batches):
            if state is None:
                if key not in states.value:
                    raise ValueError(f"{key[0]} was cut otherwise at {key[1]}; has it changed?")
                state = State(*states.value[key])
                rest, pos, open_, begun = b"", 0, state.mode == BEFORE or state.depth > 0, state.mode != BEFORE
            parts, at = [], 0
            if open_:
                if state.mode == BEFORE:
                    # The bracket stays with the first item, and tells it from others.
                    at = data.find(b"[") if b"[" in data else len(data)
                state, places, closed = advance(data, state)
                for place in places.tolist():
                    if closed >= 0 and place > closed:
                        break
                    item = rest + data[at:place]
                    # What was begun in an earlier block goes on to the first end in this one.
                    parts.append(("head" if begun else "whole", pos, item))
                    rest, at, pos, begun = b"", place, pos + 1, False
                if closed >= 0:
                    left = rest + data[at:closed]
                    if begun:
                        # Nothing ended here: a fragment may be behind it.
                        parts.append(("close", pos, left))
                    elif not CLOSING.fullmatch(left):
                        raise ValueError(f"MALFORMED archive {key[0]}: {left[-200:]!r} stands behind the last post")
                    rest, open_ = b"", False
                    data = data[closed:]
                else:
                    rest += data[at:]
            if not open_ and b"]" in data:
                raise ValueError(f"MALFORMED archive {key[0]}: more brackets behind the array")
            if ends:
                if open_ and rest:
                    parts.append(("middle" if begun else "tail", pos, rest))
                state = None
            if parts:
                yield rows_of(key, parts)

    return items


def _json_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items' bytes to their JSON text: without the bracket or comma before them, and bytes that are no UTF-8 left out."""
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            item = text.lstrip(_BLANK)
            if item[:1] not in (b"[", b","):
                raise ValueError(f"MALFORMED archive, no comma between posts: {item[:200]!r}")
            found.append(item[1:].decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("block"), batch.column("pos"), pa.array(found, pa.string())],
            names=["path", "block", "pos", "item"])


def archive_items(spark: SparkSession, pattern: str) -> DataFrame:
    """path, block, pos and item (JSON) of the arrays in all files; the first three order a file's items.

    Files without a whole array, and anything but objects in one, raise an error.
    """
    pieces = _pieces(spark, pattern)
    effects = pieces.mapInArrow(_effects, "path string, block long, modes array<int>, depths array<long>")
    along = effects.groupBy("path").applyInPandas(_along, "path string, block long, mode int, depth long")
    # One entry per block, of which planning the scan made an object each already.
    states = spark.sparkContext.broadcast({(r["path"], r["block"]): (r["mode"], r["depth"]) for r in along.collect()})
    cut = materialise(pieces.mapInArrow(_items(states), "path string, block long, pos long, kind string, text binary"), "archive_items")

    # Along a file: a tail, middles, and the head that ends the item.
    place = F.when(F.col("kind") == "head", 0).when(F.col("kind") == "tail", 2).otherwise(1)
    fragments = cut.where("kind <> 'whole'").withColumn("place", place)
    before = Window.partitionBy("path").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = fragments.withColumn("number", F.coalesce(F.sum((F.col("kind") == "head").cast("int")).over(before), F.lit(0)))
    joined = numbered.groupBy("path", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "place", "kind", "pos", "text"))).alias("parts"))
    whole = joined.select(
        "path", F.expr("element_at(parts, -1).block").alias("block"), F.expr("element_at(parts, -1).pos").alias("pos"),
        F.expr("element_at(parts, -1).kind").alias("kind"),
        F.expr("aggregate(parts, CAST('' AS binary), (a, p) -> concat(a, p.text))").alias("text"))
    # Behind the last item of an array there may be fragments that only close it.
    closing = whole.where("kind <> 'head'").select(F.assert_true(
        F.col("text").cast("string").rlike(r"^\[?[ \t\r\n]*\]$"), F.concat(F.lit("MALFORMED archive, text behind the last post: "), F.col("path"))).alias("fine"))
    closing.write.format("noop").mode("overwrite").save()
    items = cut.where("kind = 'whole'").drop("kind").unionByName(whole.where("kind = 'head'").drop("kind"))
    return items.mapInArrow(_json_of, "path string, block long, pos long, item string")


def read_post_archive(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts with ``ord``: file order, then position in the array.

    ``path`` may be a pattern over many archives, whose files may be of any size.
    Malformed files and paths without any file raise an error.
    """
    items = archive_items(spark, archive_pattern(path))
    post = F.from_json("item", _item_type(), {"mode": "FAILFAST", "allowSingleQuotes": "false", **NO_LIMITS})
    placed = items.select(F.split("path", "/").alias("file"), "block", "pos", post.alias("item"))
    return placed.select(*_unwrapped(), F.struct("file", "block", "pos").alias("ord"))


def parse_archive(files: DataFrame) -> DataFrame:
    """Posts of archive files (path, value): from the first bracket to the last, envelopes removed."""
    array = F.regexp_extract("value", r"(?s)\[.*\]", 0)
    payload = F.when(array != "", array).otherwise(F.col("value"))
    posts = F.from_json(payload, f"array<{_item_type()}>", {"mode": "FAILFAST", "allowSingleQuotes": "false", **NO_LIMITS})
    exploded = files.select(F.split("path", "/").alias("file"), F.posexplode(posts).alias("pos", "item"))
    return exploded.select(*_unwrapped(), F.struct("file", "pos").alias("ord"))


def _item_type() -> str:
    fields = ", ".join(field.replace(" ", ": ") for field in RAW_POST.split(", "))
    return f"struct<tweet: struct<{fields}>, {fields}>"


def _unwrapped() -> list:
    """The post's fields, from the envelope if there is one."""
    names = [field.split()[0] for field in RAW_POST.split(", ")]
    return [
        F.when(F.col("item.tweet").isNotNull(), F.col(f"item.tweet.{name}")).otherwise(F.col(f"item.{name}")).alias(name)
        for name in names
    ]
