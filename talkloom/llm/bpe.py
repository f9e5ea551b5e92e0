"""BPE encoding and decoding by a distinct-word table.

Text is split into the tokenizer's words (pre-tokens). Each block of documents numbers
its words in the order they turn up and keeps, for every document, the numbers only.
The words themselves go to parts by their checksum; there, the words of all blocks meet,
and each distinct word is encoded once. The ids come back to their block, take the place
of the numbers, and are decoded by joining each id with its piece.

A frequent word arrives at its part once per block, so no part is hot. Blocks and parts
are packed and compressed, as the tables are incompressible otherwise.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from talkloom.session import new_folder

#: The byte-level tokenizer's pattern (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the texts that share one numbering of words; a longer text is a block of its own.
BLOCK = 6_000_000
#: Words handed to the tokenizer at once.
BATCH = 4_096

_PACKED = "block long, part int, first binary, second binary, third binary"


@cache
def _unassigned() -> regex.Pattern:
    """Finds code points without a meaning so far."""
    ranges, before = [], -2
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if c != before + 1:
                ranges.append([c, c])
            ranges[-1][1] = before = c
    return regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


class Splitter:
    """Splits texts as the tokenizer does: at its special tokens first, then by the pattern.

    Libraries of different age disagree on code points that newer versions of Unicode
    have taken into use. Texts with such characters are left to the tokenizer itself.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        longest_first = sorted(specials, key=len, reverse=True)
        self.tokenizer = tokenizer
        self.words = regex.compile(PATTERN).findall
        self.beyond = regex.compile("[^\x00-\u052f]").search
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if specials else None

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and self.beyond(text) and _unassigned().search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.words(text)

    def __call__(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self._split(text)
        found: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            found += [part] if i % 2 else self._split(part)
        return found


class _Numbers(dict):
    """A number for each key, in the order they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _pack(values: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return _pack(np.array([len(w) for w in words], dtype=np.uint32)), zstandard.compress(b"".join(words), 3)


def _unpack_words(sizes: bytes, words: bytes) -> list[bytes]:
    data, ends = zstandard.decompress(words), np.cumsum(_unpack(sizes), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file, which tasks get instead of its path."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def tokenizer_of(content: str) -> Tokenizer:
    # A task has one core; threads of the library's own would each keep memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable ones themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in set(printable)):
        table[chr(256 + i)] = b
    return table


def pieces(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes that each id stands for; ids without a piece stand for none."""
    byte, vocabulary = _byte_of_character(), tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        known = all(c in byte for c in piece)
        table[number] = bytes(byte[c] for c in piece) if known else piece.encode()
    return table


def _number(content: str, parts: int):
    """Documents (doc_id, text) to one row per block with the words' numbers, and one per part with its words."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(tokenizer_of(content))
        schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("first", pa.binary()),
                            ("second", pa.binary()), ("third", pa.binary())])
        block, size, numbers, docs = TaskContext.get().partitionId() << 32, 0, _Numbers(), []

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.array([0 if d is None else d for d, _ in docs], dtype=np.int64).tobytes()
            missing = bytes(d is None for d, _ in docs)
            counts = np.array([len(codes) for _, codes in docs], dtype=np.uint32)
            codes = np.concatenate([codes for _, codes in docs]) if docs else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_pylist([
                {"block": block, "part": -1, "first": ids + missing, "second": _pack(counts), "third": _pack(codes)}], schema)
            dealt: dict[int, tuple[list[int], list[bytes]]] = {}
            for word, code in numbers.items():
                data = word.encode()
                into = dealt.setdefault(zlib.crc32(data) % parts, ([], []))
                into[0].append(code)
                into[1].append(data)
            for part, (of_part, words) in dealt.items():
                sizes, data = _pack_words(words)
                # Neighbouring numbers differ by little, so that the differences pack well.
                steps = np.diff(np.array(of_part, dtype=np.uint32), prepend=np.uint32(0))
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "part": part, "first": _pack(steps), "second": sizes, "third": data}], schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                words = split(text)
                docs.append((doc, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
                size += len(text) + 1
                if size >= BLOCK:
                    yield from flush()
                    block, size, numbers, docs = block + 1, 0, _Numbers(), []
        if docs:
            yield from flush()

    return number


def _encode_words(content: str):
    """Words of each part, of all blocks one after the other, to their ids; each distinct word is encoded once."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, part, known = tokenizer_of(content), None, {}
        run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.part != part:
                    part, known = row.part, {}
                words = _unpack_words(row.second, row.third)
                new = [w for w in words if w not in known]
                for start in range(0, len(new), BATCH):
                    some = new[start:start + BATCH]
                    for word, encoded in zip(some, run([w.decode() for w in some], add_special_tokens=False)):
                        known[word] = encoded.ids
                found = [known[w] for w in words]
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                ids = np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
                yield pd.DataFrame({"block": [row.block], "part": [row.part], "first": [row.first],
                                    "second": [_pack(counts)], "third": [_pack(ids)]})

    return encode


def _assemble(content: str):
    """A block's numbers and the ids of its words to the ids and the decoded text of each document."""
    table: list[list[bytes]] = []

    def assemble(numbered: pa.Table, words: pa.Table) -> pa.Table:
        if not table:
            table.append(pieces(tokenizer_of(content)))
        docs = numbered.to_pylist()[0]
        counts, codes = _unpack(docs["second"]).astype(np.int64), _unpack(docs["third"])
        doc_ids = np.frombuffer(docs["first"], np.int64, len(counts))
        missing = np.frombuffer(docs["first"], np.uint8, offset=8 * len(counts)).astype(bool)

        # Where the ids of each numbered word are, and how many.
        rows = [[_unpack(row[c]) for c in ("first", "second", "third")] for row in words.to_pylist()]
        number = np.concatenate([np.cumsum(steps, dtype=np.uint32) for steps, _, _ in rows] or [np.zeros(0, np.uint32)])
        size = np.concatenate([sizes for _, sizes, _ in rows] or [np.zeros(0, np.uint32)]).astype(np.int64)
        of_words = np.concatenate([ids for _, _, ids in rows] or [np.zeros(0, np.uint32)]).astype(np.int32)
        size_of, start_of = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        size_of[number], start_of[number] = size, np.cumsum(size) - size

        ids, ends, texts, first = [], [0], [], 0
        for count in counts.tolist():
            own, first = codes[first:first + count], first + count
            size = size_of[own]
            # The ids of the words one after the other: each word's start, plus 0, 1, 2 ... within the word.
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found = of_words[np.repeat(start_of[own], size) + within]
            ids.append(found)
            ends.append(ends[-1] + len(found))
            texts.append(b"".join(map(table[0].__getitem__, found.tolist())).decode("utf-8", "replace"))
        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64(), mask=missing),
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())),
            "decoded": pa.array(texts, pa.string())})

    return assemble


def _bucketed(df: DataFrame, column: str, buckets: int, path: str) -> DataFrame:
    """``df`` written to ``path`` with the rows of each value in one bucket, so that a later join finds them there."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "uncompressed").saveAsTable(name)
    stored = spark.table(name)
    # The table is external: its files stay, only the name goes.
    spark.sql(f"DROP TABLE {name}")
    return stored


def encode(documents: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
           parts: int | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) for every row.

    Ids are the tokenizer's, without added special tokens; a special token that stands
    in the text is encoded as such. A null text counts as empty: no ids, and the empty
    string. Rows with the same id are encoded each for itself. ``tokenizer_path`` is a
    byte-level tokenizer file on the driver; its content goes to the tasks. ``parts`` is
    the number of parts of the word table (default: the session's shuffle partitions).
    """
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = read_tokenizer(tokenizer_path)
    named = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = _bucketed(named.mapInArrow(_number(content, parts), _PACKED), "block", parts, new_folder(spark, "bpe_blocks"))
    words = packed.where("part >= 0").repartition(parts, "part").sortWithinPartitions("part")
    encoded = words.mapInPandas(_encode_words(content), _PACKED)
    return packed.where("part < 0").groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(
        _assemble(content), "doc_id long, ids array<int>, decoded string")
