"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes decides where a text is cut: a place has level k
if the hash there ends in k one bits, and a block size of ``2 ** k`` cuts at all places of
level k or more. As only the nearest bytes decide, an edit moves no cut beyond its surroundings.
Each piece becomes two letters of a checksum. The block size is the smallest at which a text has
at most ``MOST`` pieces; the pieces at that size and at twice that size make the fingerprint
``size:pieces:pieces``. Two fingerprints are compared where they have a size in common, by the
edit distance of their pieces; if they have none, their likeness is 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from talkloom.session import materialise

WINDOW = 7
#: Pieces of a fingerprint at its smaller block size, at most.
MOST = 64
#: Smallest block size is two to this power.
SMALLEST = 2
#: Bytes looked at at once.
PIECE = 1 << 20

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Letters of a piece.
_PER_PIECE = 2
_PAIRS = [a + b for a in _LETTERS for b in _LETTERS]
_FACTOR = np.uint32(0x5BD1E995)


def levels(data: bytes) -> np.ndarray:
    """The level of each byte's place, as one byte each."""
    found = np.empty(len(data), dtype=np.uint8)
    source = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, len(data), PIECE):
        end = min(start + PIECE, len(data))
        # Before the text there are zeros.
        lead = min(start, WINDOW - 1)
        near = np.zeros(end - start + WINDOW - 1, dtype=np.uint32)
        near[WINDOW - 1 - lead:] = source[start - lead:end]
        rolled = near[:end - start].copy()
        for k in range(1, WINDOW):
            rolled *= _FACTOR
            rolled += near[k:k + end - start]
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x2C1B3C6D)
        rolled ^= rolled >> np.uint32(13)
        # The ones at the end: what adding one turns over, less the bit it sets.
        found[start:end] = np.bitwise_count(rolled ^ (rolled + np.uint32(1))) - np.uint8(1)
    return found


def _pieces(data: bytes, cuts: np.ndarray) -> str:
    """Letters of the pieces that end after each cut, and of what is left."""
    ends = (cuts + 1).tolist()
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    view, start, letters = memoryview(data), 0, []
    for end in ends:
        if end > start:
            letters.append(_PAIRS[xxhash.xxh3_64_intdigest(view[start:end]) & 4095])
        start = end
    return "".join(letters)


def fingerprint(text: str | None) -> str:
    """``size:pieces:pieces at twice that size`` of the whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    level = levels(data)
    at_level = np.bincount(level, minlength=34)
    # Places of each level or a higher one; the last piece needs no cut.
    at_least = np.cumsum(at_level[::-1])[::-1]
    size = SMALLEST
    while at_least[size] >= MOST:
        size += 1
    cuts = np.flatnonzero(level >= size)
    return f"{1 << size}:{_pieces(data, cuts)}:{_pieces(data, cuts[level[cuts] > size])}"


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions, deletions and substitutions that turn a into b; one column of the table at a time, as bits."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, item in enumerate(a):
        places[item] = places.get(item, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    # Where going down the column adds one, and where it takes one off.
    more, less, distance = every, 0, len(a)
    for item in b:
        same = places.get(item, 0)
        diagonal = (((same & more) + more) ^ more) | same | less
        across_more = less | ~(diagonal | more) & every
        across_less = more & diagonal
        distance += bool(across_more & last) - bool(across_less & last)
        across_more = (across_more << 1 | 1) & every
        across_less = across_less << 1 & every
        more = across_less | ~(diagonal | across_more) & every
        less = across_more & diagonal
    return distance


def likeness(one: str, other: str) -> float:
    """1 less the edit distance of the pieces over the longer one's number, at a block size that both have.

    Two sizes in common: the larger likeness. Equal fingerprints have 1.
    """
    if one == other:
        return 1.0

    def sizes(mark: str) -> dict[int, list[str]]:
        size, small, large = mark.split(":")
        cut = lambda s: [s[i:i + _PER_PIECE] for i in range(0, len(s), _PER_PIECE)]
        return {int(size): cut(small), 2 * int(size): cut(large)}

    a, b = sizes(one), sizes(other)
    found = [0.0]
    for size in a.keys() & b.keys():
        longer = max(len(a[size]), len(b[size]))
        if longer:
            found.append(1 - edit_distance(a[size], b[size]) / longer)
    return max(found)


def spliced(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_ROW = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(text: str, mark: str, following: str, following_mark: str) -> dict:
    edited = spliced(text, following)
    edited_mark = mark if edited == text else fingerprint(edited)
    return {"n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
            "fingerprint": mark, "edited_fingerprint": edited_mark, "near_edited": likeness(mark, edited_mark),
            "near_next": likeness(mark, following_mark)}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [squeeze((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column("text")]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to their results. The first row's text, and the last row with it, are also handed on: place
    is 'first' or 'last', part the partition; the last row has no result yet."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.string()), ("part", pa.int32()), ("text", pa.large_string()), *_ROW])
    unpack = zstandard.ZstdDecompressor().decompress
    before = None
    for batch in batches:
        rows = []
        for doc, value in zip(batch.column("doc_id"), batch.column("text")):
            doc, text = doc.as_py(), unpack(value.as_py()).decode("utf-8")
            # Equal neighbours are told apart by nothing, so that one fingerprint does for them.
            mark = before[2] if before is not None and before[1] == text else fingerprint(text)
            if before is None:
                rows.append({"place": "first", "part": part, "text": text})
            else:
                rows.append({"doc_id": before[0], **_judge(before[1], before[2], text, mark)})
            before = (doc, text, mark)
        yield pa.RecordBatch.from_pylist(rows, schema)
    if before is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": before[0], "place": "last", "part": part, "text": before[1]}], schema)


def _border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows with the text that follows to their results."""
    schema = pa.schema([("doc_id", pa.int64()), *_ROW])
    for batch in batches:
        yield pa.RecordBatch.from_pylist([
            {"doc_id": row["doc_id"], **_judge(row["text"], fingerprint(row["text"]), row["following"], fingerprint(row["following"]))}
            for row in batch.to_pylist()], schema)


def with_next(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next document is that with the next smaller id, after the last one the first again; the
    edited text is :func:`spliced` with it. Rows without an id come last; rows of the same id are put
    in order by a hash of their text. Null texts count as empty. The only row of a table is
    its own next one. Two empty texts have the likeness 1. Further columns of the input play no part.

    Texts are shuffled once, compressed, into ranges of the ids. Within a range each row meets its next one while
    they stream by; a range's last row meets the next range's first text, one of each per range, afterwards.
    """
    named = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Rows of one id are spread by their texts' hash and, if that is equal too, by their place in the input.
    keys = [F.desc_nulls_last("doc_id"), F.asc("hash")]
    keyed = named.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    packed = keyed.mapInArrow(_pack, "doc_id long, text binary, hash long, place long")
    ranges = packed.repartitionByRange(*keys, F.asc("place"))
    in_order = ranges.sortWithinPartitions(*keys).select("doc_id", "text")
    met = materialise(in_order.mapInArrow(_along, f"doc_id long, place string, part int, text string, {_DDL}"), "fingerprints")

    results = ["doc_id", *[name for name, _ in _ROW]]
    firsts, lasts = met.where("place = 'first'").select("part", F.col("text").alias("following")), met.where("place = 'last'")
    # One number per range; the range after the last one is the first one.
    parts = sorted(r["part"] for r in firsts.select("part").collect())
    after = documents.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, then int")
    facing = lasts.select("doc_id", "part", "text").join(after, "part").join(
        firsts.withColumnRenamed("part", "then"), "then").select("doc_id", "text", "following")
    return met.where("place IS NULL").select(*results).unionByName(facing.mapInArrow(_border, f"doc_id long, {_DDL}"))
