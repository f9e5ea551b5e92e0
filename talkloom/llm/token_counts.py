"""Edit-aware token counts.

Each document keeps a segment tree: its leaves are runs of at most ``LEAF`` pre-tokens
with their characters and tokens, and each node above has the sums of the two below. When
a document is edited, the tree finds the leaves that an edit touches. These, with one leaf
of context before them, are split and encoded again until the new split meets an old leaf
border behind the edit; the sums on the way to the root are then brought up to date. All
other leaves keep their counts, and texts without an edit are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from talkloom.operators.lookup import lookup
from talkloom.session import materialise

#: The byte-level tokenizer's pattern (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
#: Distinct pre-tokens whose count a task remembers.
REMEMBERED = 500_000

TREE = "chars array<int>, tokens array<int>"
EDITS = "array<struct<start:int,length:int,replacement:string>>"
_split = regex.compile(PATTERN).findall


def read_ranks(path: str) -> dict[bytes, int]:
    """A tokenizer file of base64 pieces and ranks; the ranks go to the tasks."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, pre_token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[pre_token] = count = len(self.encode(pre_token))
        return count

    def of(self, pre_tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pre_tokens), np.int64, len(pre_tokens))


class Tree:
    """Sums of characters and tokens; node i has the nodes 2i and 2i + 1 below it, leaves are in the last half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens = np.array(chars, dtype=np.int64), np.array(tokens, dtype=np.int64)

    @classmethod
    def of_leaves(cls, chars: np.ndarray, tokens: np.ndarray) -> "Tree":
        size = 1 << max(0, len(chars) - 1).bit_length()
        tree = cls(np.zeros(2 * size), np.zeros(2 * size))
        for sums, leaves in ((tree.chars, chars), (tree.tokens, tokens)):
            sums[size:size + len(leaves)] = leaves
            while size > 1:
                sums[size // 2:size] = sums[size:2 * size:2] + sums[size + 1:2 * size:2]
                size //= 2
            size = len(sums) // 2
        return tree

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at ``offset`` (the last one, beyond the end), and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if offset - start >= self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def update(self, first: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """New leaves from ``first`` on, and the sums above them."""
        low, high = self.size + first, self.size + first + len(chars) - 1
        self.chars[low:high + 1], self.tokens[low:high + 1] = chars, tokens
        while low > 1:
            low, high = low // 2, high // 2
            for sums in (self.chars, self.tokens):
                sums[low:high + 1] = sums[2 * low:2 * high + 2:2] + sums[2 * low + 1:2 * high + 2:2]


def _runs(values: np.ndarray, leaves: int) -> np.ndarray:
    """``values`` summed up in so many runs of about the same length; some are empty if there are few values."""
    ends = np.arange(1, leaves + 1) * len(values) // leaves
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)


def plant(text: str | None, counter: Counter) -> Tree:
    """The tree of a whole text; null and empty texts have one empty leaf."""
    words = _split(text or "")
    leaves = max(1, -(-len(words) // LEAF))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return Tree.of_leaves(_runs(sizes, leaves), _runs(counter.of(words), leaves))


def edit(tree: Tree, text: str, start: int, length: int, replacement: str, counter: Counter) -> tuple[Tree, str, int]:
    """The tree and the text after one edit, and the characters that were split again.

    The edit replaces ``length`` characters from ``start``, cut off at the text's end.
    """
    start = min(max(start, 0), len(text))
    end = min(start + max(length, 0), len(text))
    after = text[:start] + replacement + text[end:]
    shift = len(after) - len(text)
    # The character before the edit may go together with it; a leaf more makes sure of what precedes that.
    first, begin = tree.find(max(start - 1, 0))
    if first:
        first, begin = tree.find(begin - 1)
    last, last_start = tree.find(end)
    border = last_start + int(tree.chars[tree.size + last])
    while True:
        follow, follow_start = tree.find(border)
        reach = max(border, follow_start + int(tree.chars[tree.size + follow]))
        words = _split(after[begin:reach + shift])
        ends = begin + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        # With the leaf behind it in view, a border that both splits have parts them for good.
        meets = int(np.searchsorted(ends, border + shift))
        if reach >= len(text) and border >= len(text):
            meets = len(words)
            break
        if border + shift == begin or meets < len(ends) and ends[meets] == border + shift:
            meets = 0 if border + shift == begin else meets + 1
            break
        last, border = follow, reach
    words = words[:meets]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    leaves = last - first + 1
    again = int(sizes.sum())
    if len(words) <= 2 * LEAF * leaves:
        tree.update(first, _runs(sizes, leaves), _runs(counter.of(words), leaves))
        return tree, after, again
    # Much more text than the leaves may hold: the same counts, in a tree with more leaves.
    more = -(-len(words) // LEAF)
    parts = []
    for sums, new in ((tree.chars, _runs(sizes, more)), (tree.tokens, _runs(counter.of(words), more))):
        old = sums[tree.size:]
        parts.append(np.concatenate([old[:first], new, old[last + 1:]]))
    used = int(np.flatnonzero(parts[0]).max(initial=0)) + 1
    return Tree.of_leaves(parts[0][:used], parts[1][:used]), after, again


def build(documents: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, version (a hash of the text), chars and tokens: the segment tree of every row.

    The document's token count is the root's sum, ``tokens[1]``.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            found = [plant(t.as_py(), counter) for t in batch.column("text")]
            sums = [pa.array([getattr(t, side).astype(np.int32) for t in found], pa.list_(pa.int32()))
                    for side in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), *sums], names=["doc_id", "version", "chars", "tokens"])

    return versions(documents, doc_id, text).mapInArrow(trees, "doc_id long, version long, " + TREE)


def versions(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, version, text: what tells two rows apart is their id and a hash of their text."""
    return documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"), F.col(text).alias("text"))


def recount(edited: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, version, chars, tokens, text, n_edits and chars_encoded after the edits of each row.

    ``edited`` has doc_id, version, text (before the edits), chars, tokens (its tree) and
    edits: start, length and replacement, in characters of the text before all edits. They
    are applied from the last to the first; where two overlap, the earlier one ends at the
    start of the later one.
    """
    ranks = edited.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("chars", pa.list_(pa.int32())),
                            ("tokens", pa.list_(pa.int32())), ("text", pa.string()), ("n_edits", pa.int64()),
                            ("chars_encoded", pa.int64())])
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                tree, text, encoded = Tree(row["chars"], row["tokens"]), row["text"] or "", 0
                edits, limit = row["edits"] or [], len(text)
                for e in sorted(edits, key=lambda e: (e["start"], e["length"]), reverse=True):
                    start = min(max(e["start"], 0), limit)
                    length = min(max(e["length"], 0), limit - start)
                    tree, text, chars = edit(tree, text, start, length, e["replacement"] or "", counter)
                    encoded, limit = encoded + chars, start
                rows.append({"doc_id": row["doc_id"], "version": row["version"], "chars": tree.chars,
                             "tokens": tree.tokens, "text": text, "n_edits": len(edits), "chars_encoded": encoded})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return edited.select("doc_id", "version", "text", "chars", "tokens", "edits").mapInArrow(
        again, f"doc_id long, version long, {TREE}, text string, n_edits long, chars_encoded long")


#: What :func:`scrubbing` replaces, and by what.
PRIVATE = (
    ("[email]", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("[address]", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("[phone]", r"(?<![\w.])\+?\d[\d() -]{7,}\d\b"),
    ("[secret]", r"\b(?=\w*\d)(?=\w*[A-Za-z])\w{24,}\b"),
)


def scrubbing(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, version, text, edits: the rows that hold personal data or secrets, and the edits that take these out."""
    private = regex.compile("|".join(f"({pattern})" for _, pattern in PRIVATE))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("replacement", pa.string())]))
        for batch in batches:
            edits = [[{"start": m.start(), "length": m.end() - m.start(), "replacement": PRIVATE[m.lastindex - 1][0]}
                      for m in private.finditer(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(edits, kind)], names=["doc_id", "version", "text", "edits"])

    # Every pattern has an @ or a digit in it, of any script. What the JVM's Unicode does not know yet
    # (Cn) can be a digit for the patterns.
    some = versions(documents, doc_id, text).where(F.col("text").rlike(r"[@\p{Nd}\p{Cn}]"))
    return some.mapInArrow(find, f"doc_id long, version long, text string, edits {EDITS}").where(F.size("edits") > 0)


def counts_after(trees: DataFrame, edits: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after and chars_encoded for every row of ``trees``.

    ``trees`` comes from :func:`build`, ``edits`` has doc_id, version, text and edits. Only
    the trees of edited documents are joined with their text. Rows with the same id and
    text have the same edits. A null text counts as empty; rows without an id are counted
    but not edited.
    """
    key = ["doc_id", "version"]
    edited = materialise(edits.where("doc_id IS NOT NULL").dropDuplicates(key), "token_edits")
    state = trees.join(edited.select(key), key, "left_semi").dropDuplicates(key)
    after = recount(edited.join(state, key), ranks_path).select(
        *key, "n_edits", F.element_at("tokens", 2).cast("long").alias("n_tokens_after"), "chars_encoded")
    counted = trees.select(*key, F.element_at("tokens", 2).cast("long").alias("n_tokens"))
    joined = lookup(counted, materialise(after, "token_counts_after"), key)
    return joined.select(
        "doc_id", "n_tokens", F.coalesce("n_edits", F.lit(0)).cast("long").alias("n_edits"),
        F.coalesce("n_tokens_after", "n_tokens").alias("n_tokens_after"),
        F.coalesce("chars_encoded", F.lit(0)).cast("long").alias("chars_encoded"))
