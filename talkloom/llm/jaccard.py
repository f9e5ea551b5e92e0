"""N-gram Jaccard join by signature trees.

Documents link when the Jaccard similarity of their shingle sets is at least a threshold
(0.9 unless another is given). Equal sets are one class, and classes are joined, not
documents.

*Which trees meet.* Two sets that link differ in at most ``d`` hashes, which their sizes
tell. Cut the range of hashes into more than ``d`` parts, and one part is the same in both:
the hashes in a part make a key. Parts with fewer than two hashes that are not in many
documents say little and make none; a set that has too many of them to be sure of a
shared key gives neighbour pairs as keys as well (each hash that only one of two sets has tears two
pairs of its own set or one of the other, so that linked sets share one of the first
``floor(2 * (1 - t) * n) + 1`` pairs). Sets with the same first hashes and about the same size form a
leaf. Keys and leaves travel packed, and only the groups of leaves that share a key come out.

*What is compared.* Leaves are cut into chunks of bounded size. Each chunk is a signature
tree: its nodes hold the size range of their sets and the OR of their token bitmaps. Two
trees are walked together; a pair of nodes is left when the sizes, or the bits that both
have, allow no sufficient overlap. What is left is counted exactly.

*Why not all pairs of a large group.* First every chunk is compared with itself and with one chunk
of the largest leaf of its group, which connects near copies of one text with each other. Then only
sets that are not connected yet, but share a key, are compared, chunk by chunk: two parts of a group that are
connected already need no further link. Leaves of a small group are paired one by one. A large group first puts its
leaves together, each in the largest group that it is in, so that chunks of many leaves are paired and not the leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from talkloom.llm.bitmaps import may_be_in
from talkloom.llm.components import components
from talkloom.llm.shingles import WIDTH, mix, shingle_set
from talkloom.operators.lookup import lookup
from talkloom.session import materialise

#: Sets and shingles that a chunk has at most, but for a single larger set.
CHUNK_SETS = 64
CHUNK_TOKENS = 200_000
#: Leaves of a group that are paired one by one; of larger groups, leaves of at most a chunk are put together.
PAIRED = 8
#: Sets of a tree's lowest nodes.
LOWEST = 8
#: Similarity from which on sets link, in hundredths; what is compared is exact, in whole numbers.
PER_CENT = 90

#: A hash is common when COMMON or more of one in COMMON_PART texts hold it. At most COMMON_KEYS, the commonest, count
#: as such. Which ones these are decides the work, never the result.
COMMON, COMMON_PART, COMMON_KEYS = 6, 16, 1 << 18
#: Numbers counted at once, and keys packed at once.
AT_ONCE = 2_000_000
#: Bits of a key and of a leaf as they travel. Unequal ones that agree in them are compared for nothing, no more.
KEY_BITS, LEAF_BITS = 48, 32
#: Words of the filter of texts whose sets are compared, at most; it has about one for each text. It passes through the driver.
MEMBER_WORDS = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)


def least(per_cent: int = PER_CENT) -> int:
    """Shingles of the smallest set that can link with another than an equal one."""
    return -(-per_cent // (100 - per_cent))


def linked(overlap, a, b, per_cent: int = PER_CENT):
    """100 * intersection >= per_cent * union, for sets of a and b shingles."""
    return 100 * overlap >= per_cent * (a + b - overlap)


def differences(a: int, b: int, per_cent: int = PER_CENT) -> int:
    """Hashes that only one of two linked sets has, at most."""
    return (a + b) * (100 - per_cent) // (100 + per_cent)


@cache
def levels(per_cent: int) -> list[tuple[int, int]]:
    """Differences, and parts that make up for so many, of each level.

    Parts are as few as leave, with sets of the least size that differ so much, a margin of those that say something.
    """
    size = per_cent / (100 - per_cent)
    strong = lambda f: f * (1 - math.exp(-size / f) * (1 + size / f))
    factor = next((f / 100 for f in range(102, 200) if strong(f / 100) >= 1.03), 1.5)
    found, most = [], 1
    while most < 1 << 40:
        found.append((most, math.ceil(factor * most) + 2))
        most = max(most + 1, most * 3 // 2)
    return found


def _level_of(differing: int, per_cent: int) -> int:
    return next(k for k, (most, _) in enumerate(levels(per_cent)) if most >= differing)


def neighbour_pairs(tokens: np.ndarray) -> np.ndarray:
    """A hash of each two hashes of the set that follow each other."""
    return mix(tokens[:-1] * _ODD + tokens[1:])


def keys_of(tokens: np.ndarray, common: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """Keys of a set (sorted hashes), one of which every set has that it links with. ``common`` is sorted."""
    n = len(tokens)
    most = differences(n, 100 * n // per_cent, per_cent)
    if n < least(per_cent) or not most:
        return np.zeros(0, np.uint64)
    fewest = max(1, differences(n, -(-per_cent * n // 100), per_cent))
    rare = np.ones(n, dtype=bool)
    if len(common):
        at = np.searchsorted(common, tokens)
        at[at == len(common)] = 0
        rare = common[at] != tokens
    spread, found, sure = mix(tokens), [], True
    for level in range(_level_of(fewest, per_cent), _level_of(most, per_cent) + 1):
        allowed, parts = levels(per_cent)[level]
        part = (tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        strong = np.add.reduceat(rare.astype(np.int64), starts) >= 2
        content = np.add.reduceat(spread, starts) + part[starts] * _ODD + np.uint64(level + 1)
        found.append(mix(content[strong]))
        sure = sure and len(found[-1]) > min(allowed, most)
    if not sure:
        pairs = neighbour_pairs(tokens)
        telling = rare[:-1] | rare[1:]
        pairs = np.concatenate([pairs[telling], pairs[~telling]])
        found.append(pairs[:2 * (100 - per_cent) * n // 100 + 1])
    return np.concatenate(found)


def _often_met(width: int):
    """Texts to the hashes that several of a task's texts hold, with how many."""

    def often_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.append(shingle_set(text.as_py(), width))
                size += len(held[-1])
                if size >= AT_ONCE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return often_met


def common_tokens(named: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Hashes that many documents have, sorted, found in one of COMMON_PART texts."""
    some = named.where(F.pmod(F.col("version"), F.lit(COMMON_PART)) == 0).select("text")
    met = some.mapInArrow(_often_met(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = met.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(COMMON_KEYS).select("token").toPandas()
    return np.sort(most["token"].to_numpy(np.int64).view(np.uint64))


def _leaf(tokens: np.ndarray, per_cent: int) -> int:
    band = round(math.log(len(tokens)) / math.log(100 / per_cent))
    return xxhash.xxh3_64_intdigest(tokens[:2].tobytes(), seed=band) >> (64 - LEAF_BITS)


def _describe(width: int, per_cent: int):
    """doc_id, version, text to doc_id, version, n, class and leaf; without shingles, class and leaf are null."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"n": [], "class": [], "leaf": []}
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), width)
                rows["n"].append(len(tokens))
                rows["class"].append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                rows["leaf"].append(_leaf(tokens, per_cent) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("version"), pa.array(rows["n"], pa.int64()),
                pa.array(rows["class"], pa.binary()), pa.array(rows["leaf"], pa.int64())],
                names=["doc_id", "version", "n", "class", "leaf"])

    return describe


def _distinct_pairs(key: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, leaf) in order."""
    order = np.lexsort((leaf, key))
    key, leaf = key[order], leaf[order]
    once = np.append(True, (key[1:] != key[:-1]) | (leaf[1:] != leaf[:-1]))[:len(key)]
    return key[once], leaf[once]


def _key_blocks(common, width: int, per_cent: int, buckets: int):
    """text to bucket and block: the bucket's (key, leaf) pairs of many texts, packed."""

    def key_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, leaves, size = [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def flush() -> pa.RecordBatch:
            key, leaf = _distinct_pairs(np.concatenate(keys) >> np.uint64(64 - KEY_BITS), np.repeat(
                np.array(leaves, dtype=np.uint32), [len(k) for k in keys]))
            bucket = (key >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
            heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)]).tolist()
            # Keys in order differ by little from each other.
            blocks = [squeeze(np.diff(key[a:b], prepend=np.uint64(0)).tobytes() + leaf[a:b].tobytes())
                      for a, b in zip(heads, [*heads[1:], len(key)])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int64)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), width)
                found = keys_of(tokens, common.value, per_cent)
                if len(found):
                    keys.append(found)
                    leaves.append(_leaf(tokens, per_cent))
                    size += len(found)
                if size >= AT_ONCE:
                    yield flush()
                    keys, leaves, size = [], [], 0
        if keys:
            yield flush()

    return key_blocks


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by bucket to the groups of leaves that share a key: group and leaf. Keys with the same leaves make one group."""
    unpack = zstandard.ZstdDecompressor().decompress

    def groups(blocks: list[bytes]) -> pa.RecordBatch:
        keys, leaves = [], []
        for block in map(unpack, blocks):
            count = len(block) // 12
            keys.append(np.cumsum(np.frombuffer(block, np.uint64, count)))
            leaves.append(np.frombuffer(block, np.uint32, count, 8 * count))
        key, leaf = _distinct_pairs(np.concatenate(keys), np.concatenate(leaves))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(starts, len(key)))
        name = np.add.reduceat(mix(leaf.astype(np.uint64) + np.uint64(1)), starts)
        _, first = np.unique(name, return_index=True)
        wanted = first[size[first] > 1]
        row = np.repeat(starts[wanted], size[wanted])
        row = row + np.arange(len(row)) - np.repeat(np.cumsum(size[wanted]) - size[wanted], size[wanted])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(name[wanted], size[wanted]).view(np.int64)), pa.array(leaf[row].astype(np.int64))], names=["group", "leaf"])

    bucket, blocks = None, []
    for batch in batches:
        for here, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
            if here != bucket and blocks:
                yield groups(blocks)
                blocks = []
            bucket = here
            blocks.append(block.as_py())
    if blocks:
        yield groups(blocks)


def leaf_groups(named: DataFrame, width: int, per_cent: int) -> DataFrame:
    """group, leaf: leaves whose sets share a key have a group in common."""
    spark = named.sparkSession
    common = spark.sparkContext.broadcast(common_tokens(named, width))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = named.where("doc_id IS NOT NULL").select("text").mapInArrow(
        _key_blocks(common, width, per_cent, buckets), "bucket long, block binary")
    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "group long, leaf long").distinct()


def _sets(width: int):
    """text, class and the rest to the sets of those rows whose text has the class."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column("text")
            for row, text in zip(batch.drop_columns(["text"]).to_pylist(), texts):
                tokens = shingle_set(text.as_py(), width).tobytes()
                if xxhash.xxh3_128_digest(tokens) == row["class"]:
                    rows.append(row | {"tokens": tokens})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("leaf", pa.int64()), ("chunk", pa.int64()), ("class", pa.binary()), ("tokens", pa.binary())]))

    return sets


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that come by leaf and chunk to one row for each chunk, its sets by size."""

    def packed(place: tuple, sets: dict[bytes, bytes]) -> dict:
        rows = sorted((len(tokens) // 8, name, tokens) for name, tokens in sets.items())
        sizes, names, tokens = zip(*rows)
        return {"leaf": place[0], "chunk": place[1], "classes": b"".join(names),
                "sizes": np.array(sizes, np.int64).tobytes(), "tokens": b"".join(tokens)}

    schema = pa.schema([("leaf", pa.int64()), ("chunk", pa.int64()), *[(p, pa.binary()) for p in _PARTS]])
    place, sets = None, {}
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if (row["leaf"], row["chunk"]) != place:
                if sets:
                    done.append(packed(place, sets))
                place, sets = (row["leaf"], row["chunk"]), {}
            sets[row["class"]] = row["tokens"]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if sets:
        yield pa.RecordBatch.from_pylist([packed(place, sets)], schema)


class _Node:
    """Sets start..end of a chunk: their size range, the OR of their bitmaps, and two nodes below."""

    def __init__(self, chunk: "_Chunk", start: int, end: int) -> None:
        self.start, self.end, self.below = start, end, ()
        self.low, self.high = int(chunk.sizes[start]), int(chunk.sizes[end - 1])
        if end - start > LOWEST:
            middle = (start + end) // 2
            self.below = (_Node(chunk, start, middle), _Node(chunk, middle, end))
            self.bits = self.below[0].bits | self.below[1].bits
            self.excess = max(n.excess for n in self.below)
        else:
            self.bits = np.zeros(chunk.width, dtype=bool)
            self.excess = 0
            for i in range(start, end):
                own = np.unique(chunk.set_of(i) & np.uint64(chunk.width - 1)).astype(np.int64)
                self.bits[own] = True
                # Shingles that share a bit with another one of the same set.
                self.excess = max(self.excess, int(chunk.sizes[i]) - len(own))


class _Chunk:
    def __init__(self, classes: bytes, sizes: bytes, tokens: bytes, width: int) -> None:
        self.classes = [classes[i:i + 16] for i in range(0, len(classes), 16)]
        self.sizes = np.frombuffer(sizes, np.int64)
        self.tokens = np.frombuffer(tokens, np.uint64)
        self.ends = np.cumsum(self.sizes)
        self.width = width
        self.root = _Node(self, 0, len(self.sizes))

    def set_of(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i] - self.sizes[i]:self.ends[i]]


def _may_link(x: _Node, y: _Node, per_cent: int) -> bool:
    """Whether the sizes and bitmaps of two nodes leave room for a link between their sets."""
    if 100 * x.high < per_cent * y.low or 100 * y.high < per_cent * x.low:
        return False
    most = min(x.high, y.high, int(np.count_nonzero(x.bits & y.bits)) + min(x.excess, y.excess))
    return bool(linked(most, x.low, y.low, per_cent))


def _traverse(x: _Node, y: _Node, per_cent: int) -> Iterator[tuple[_Node, _Node]]:
    """Pairs of lowest nodes that survive."""
    if not _may_link(x, y, per_cent):
        return
    if not x.below and not y.below:
        yield x, y
    elif x is y:
        first, second = x.below
        yield from _traverse(first, first, per_cent)
        yield from _traverse(first, second, per_cent)
        yield from _traverse(second, second, per_cent)
    elif x.below and (not y.below or x.end - x.start >= y.end - y.start):
        for node in x.below:
            yield from _traverse(node, y, per_cent)
    else:
        for node in y.below:
            yield from _traverse(x, node, per_cent)


def _overlaps(x: _Chunk, y: _Chunk, block: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all sets of y."""
    both = np.intersect1d(x.tokens, y.tokens)
    total = np.zeros((len(x.sizes), len(y.sizes)), dtype=np.float64)

    def placed(chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
        column = np.searchsorted(both, chunk.tokens)
        known = column < len(both)
        known[known] = both[column[known]] == chunk.tokens[known]
        return row[known], column[known]

    (row_x, column_x), (row_y, column_y) = placed(x), placed(y)
    for start in range(0, len(both), block):
        parts = []
        for chunk, row, column in ((x, row_x, column_x), (y, row_y, column_y)):
            matrix = np.zeros((len(chunk.sizes), min(block, len(both) - start)), dtype=np.float32)
            inside = (column >= start) & (column < start + block)
            matrix[row[inside], column[inside] - start] = 1
            parts.append(matrix)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def chunk_links(x: _Chunk, y: _Chunk, per_cent: int = PER_CENT) -> np.ndarray:
    """Which sets of x link with which sets of y; the same chunk twice gives each pair once."""
    links = np.zeros((len(x.sizes), len(y.sizes)), dtype=bool)
    survivors = list(_traverse(x.root, y.root, per_cent))
    if survivors:
        overlap = _overlaps(x, y)
        for a, b in survivors:
            part = slice(a.start, a.end), slice(b.start, b.end)
            links[part] = linked(overlap[part], x.sizes[a.start:a.end, None], y.sizes[None, b.start:b.end], per_cent)
    if x is y:
        links = np.triu(links | links.T, 1)
    return links


def _width(tokens: int) -> int:
    return 1 << max(10, min(20, (2 * tokens).bit_length()))


_PACK = "leaf long, chunk long, classes binary, sizes binary, tokens binary"
_PARTS = ("classes", "sizes", "tokens")


def _compare(per_cent: int):
    """Pairs of chunks to class and other: for each class that links, one that it links with, directly or not."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = row.a == row.b and row.chunk_a == row.chunk_b
                width = _width(max(len(row.tokens_a), len(row.tokens_b)) // 8)
                x = _Chunk(*[getattr(row, f"{p}_a") for p in _PARTS], width)
                y = x if own else _Chunk(*[getattr(row, f"{p}_b") for p in _PARTS], width)
                links = chunk_links(x, y, per_cent)
                if not links.any():
                    continue
                names = x.classes if own else x.classes + y.classes
                shift = 0 if own else len(x.classes)
                # The smallest member of each connected part.
                root = list(range(len(names)))

                def top(i: int) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, j in zip(*[side.tolist() for side in np.nonzero(links)]):
                    i, j = top(i), top(j + shift)
                    root[max(i, j)] = min(i, j)
                used = [i for i in range(len(names)) if top(i) != i]
                yield pd.DataFrame({"class": [names[i] for i in used], "other": [names[top(i)] for i in used]})

    return compare


def _links(named: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, per_cent: int, name: str) -> DataFrame:
    """class, other: links between classes (class, doc_id, leaf) of pairs of leaves.

    ``pairs`` has a, b and star: whether one chunk of b is enough for each chunk of a, which then are compared with
    themselves too where a = b.
    """
    sized = classes.groupBy("leaf").agg(F.greatest(
        F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("long").alias("chunks"))
    for side in ("a", "b"):
        pairs = lookup(pairs, sized.select(F.col("leaf").alias(side), F.col("chunks").alias(f"chunks_{side}")), side, "inner")
    pairs = materialise(pairs, f"jaccard_{name}_pairs")
    if pairs.isEmpty():
        return named.sparkSession.createDataFrame([], "class binary, other binary")
    wanted = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("leaf"), F.col("chunks_a").alias("chunks")),
        F.struct(F.col("b").alias("leaf"), F.col("chunks_b").alias("chunks")))).alias("w")).select("w.*").distinct()
    members = lookup(classes, wanted, "leaf", "inner").select(
        "doc_id", "class", "leaf", F.pmod(F.xxhash64("class"), F.col("chunks")).alias("chunk"))
    members = materialise(members, f"jaccard_{name}_members")
    words = min(MEMBER_WORDS, 1 << max(10, members.count().bit_length()))
    texts = named.where(may_be_in(F.col("doc_id"), members, "doc_id", words)).join(members, "doc_id").select(
        "leaf", "chunk", "class", "text")
    sets = texts.mapInArrow(_sets(width), "leaf long, chunk long, class binary, tokens binary")
    in_order = sets.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk")
    packs = materialise(in_order.mapInArrow(_pack, _PACK), f"jaccard_{name}_chunks")

    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    chunked = pairs.withColumn("chunk_a", number("chunks_a")).withColumn("chunk_b", number("chunks_b"))
    # Of a leaf's own chunks each pair once; stars have the chunk 0 of b, and chunks with themselves.
    once = F.expr("(a <> b OR chunk_a <= chunk_b) AND (NOT star OR IF(a = b, chunk_a, chunk_b) = 0 OR a = b AND chunk_a = chunk_b)")
    chunked = chunked.where(once).select("a", "chunk_a", "b", "chunk_b")
    for side in ("a", "b"):
        chunked = lookup(chunked, packs.select(
            F.col("leaf").alias(side), F.col("chunk").alias(f"chunk_{side}"), *[F.col(p).alias(f"{p}_{side}") for p in _PARTS]),
            [side, f"chunk_{side}"], "inner")
    return materialise(chunked.mapInPandas(_compare(per_cent), "class binary, other binary"), f"jaccard_{name}_links")


def _unconnected(classes: DataFrame, group: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes under new leaves, and pairs of new leaves that share a group.

    A new leaf is a connected part (below 0), what is left of an old leaf, or, from 1 << 62 on, the leaves put together
    in a large group; their classes are under their own leaf as well.
    """
    part = group.select(F.col("node").alias("class"), (F.xxhash64("component").bitwiseOR(F.lit(-1 << 63))).alias("part"))
    placed = materialise(lookup(classes, part, "class").withColumn("old", F.col("leaf")).withColumn(
        "leaf", F.coalesce("part", "leaf")).drop("part"), "jaccard_parts")
    renamed = placed.groupBy("old", "leaf").agg(F.count("*").alias("classes"))
    within = renamed.select(F.col("old").alias("group"), "leaf")
    across = groups.join(renamed.select(F.col("old"), F.col("leaf").alias("new")), groups["leaf"] == F.col("old")).select("group", F.col("new").alias("leaf"))
    met = materialise(within.unionByName(across).distinct(), "jaccard_open_groups")
    several = met.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    open_groups = materialise(lookup(met, several, "group", "inner"), "jaccard_sized_groups")
    large = open_groups.where(F.col("n") > PAIRED)
    # Parts and leaves of more than a chunk stay as they are: there are few of them, and a part needs no comparison with itself.
    small = placed.groupBy("leaf").agg(F.count("*").alias("classes")).where(F.col("classes") <= CHUNK_SETS).select("leaf")
    chosen = large.groupBy("leaf").agg(F.max_by("group", F.struct("n", "group")).alias("into")).join(small, "leaf", "left_semi")
    into = materialise(chosen.select(
        "leaf", F.col("into").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)).alias("into")), "jaccard_put_together")
    together = lookup(large, into, "leaf").select("group", F.coalesce("into", "leaf").alias("leaf")).distinct()
    paired = open_groups.where(F.col("n") <= PAIRED).select("group", "leaf").unionByName(together)
    left, right = paired.select("group", F.col("leaf").alias("a")), paired.select("group", F.col("leaf").alias("b"))
    between = left.join(right, "group").where("a < b").select("a", "b").distinct()
    placed = placed.drop("old")
    placed = placed.unionByName(lookup(placed, into, "leaf", "inner").withColumn("leaf", F.col("into")).drop("into"))
    alone = placed.where("leaf >= 0").groupBy("leaf").agg(F.count("*").alias("classes")).where("classes > 1").select(
        F.col("leaf").alias("a"), F.col("leaf").alias("b"))
    return placed, between.unionByName(alone).withColumn("star", F.lit(False))


def join(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id and version for every row.

    Documents link when their sets of shingles of ``width`` words have a Jaccard similarity
    of ``per_cent`` hundredths, 70 to 99, or more.
    component_id is the smallest doc_id that links lead to, the row's own included. Texts
    without a word, and null, have no shingles and no links. Rows with the same id and
    text are copies of each other; rows with the same id and other texts are judged each
    by its text. Rows without an id link with nothing, and their component is null.
    version is a hash of the row's text. Shingles are compared by 64-bit hashes.
    """
    # Below 70, linked sets of few shingles may have no neighbour pair in common.
    if width < 1 or not 70 <= per_cent <= 99:
        raise ValueError(f"width {width} must be 1 or more, per_cent {per_cent} from 70 to 99")
    named = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    described = materialise(
        named.mapInArrow(_describe(width, per_cent), "doc_id long, version long, n long, class binary, leaf long"), "jaccard_sets")
    classes = materialise(described.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.min("leaf").alias("leaf"), F.min("n").alias("n")), "jaccard_classes")
    groups = materialise(leaf_groups(named, width, per_cent), "jaccard_groups")

    # Near copies of one text: each leaf with itself, and with the largest one of each of its groups.
    sized = classes.groupBy("leaf").agg(F.count("*").alias("classes"))
    ranked = lookup(groups, sized, "leaf", "inner")
    hubs = ranked.groupBy("group").agg(F.max_by("leaf", F.struct("classes", "leaf")).alias("b"))
    to_hub = lookup(ranked.select("group", F.col("leaf").alias("a")), hubs, "group").where("a <> b").select("a", "b")
    own = sized.where("classes > 1").select(F.col("leaf").alias("a"), F.col("leaf").alias("b"))
    stars = to_hub.distinct().unionByName(own).withColumn("star", F.lit(True))
    near = _links(named, classes, stars, width, per_cent, "star")
    # What is not connected yet: all that share a key.
    group = materialise(components(near, "class", "other", "jaccard_near"), "jaccard_near_parts")
    placed, rest = _unconnected(classes, group, groups)
    far = _links(named, placed, rest, width, per_cent, "rest")
    if not far.isEmpty():
        # What is connected already goes on as one edge per class.
        edges = group.select(F.col("node").alias("class"), F.col("component").alias("other"))
        group = components(edges.unionByName(far), "class", "other", "jaccard")
    parts = lookup(classes, group.withColumnRenamed("node", "class"), "class").select(
        "class", F.coalesce("component", "class").alias("component"), "doc_id")
    first = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = lookup(parts.drop("doc_id"), first, "component").select("class", "component_id")
    joined = lookup(described.select("doc_id", "version", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")),
                    of_class, "class")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "version")
