"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from talkloom.llm.arrays import distinct

WIDTH = 3
#: Bytes hashed at once.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True


def _powers(base: int, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1) modulo 2 ** 64."""
    powers = np.ones(1, dtype=np.uint64)
    while len(powers) < count:
        step = np.uint64(pow(base, len(powers), 1 << 64))
        powers = np.concatenate([powers, powers * step])
    return powers[:count]


class _Tables:
    """Powers of an odd base and of its inverse, made when first needed and as long as needed."""

    base = 0x2545F4914F6CDD1D

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            count = max(count, 1 << 14)
            self.up = _powers(self.base, count)
            self.down = _powers(pow(self.base, -1, 1 << 64), count)
        return self.up, self.down


_TABLES = _Tables()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: bytes) -> np.ndarray:
    """A hash of each word of ``data``: the polynomial of its bytes, from one running sum over all."""
    text = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SPACES[text]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = _TABLES.upto(len(text) + 1)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:len(text)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * _ODD)


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut at white space into pieces of about PIECE bytes; a longer word makes a longer piece."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and not _SPACES[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def word_hashes(text: str) -> np.ndarray:
    """One hash per word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    # bytes.lower changes ASCII letters only.
    found = [_hash_words(piece) for piece in _pieces(text.encode("utf-8", "replace").lower())]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of ``width`` words as sorted hashes; fewer words make one shingle, none make none."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        total = mix(total * _ODD + words[j:j + len(total)])
    return distinct(total)
