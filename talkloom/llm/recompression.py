"""Run-length grammars by recompression, and longest common extensions on them.

A sequence of symbols is compressed level by level. Block compression turns each stretch
of one symbol into a symbol of its own, named by symbol and length. Pair compression sorts
the symbols into left and right ones and turns each left one followed by a right one into a
symbol named by the two. Both look only at a symbol's neighbours, so that equal stretches
are parsed alike but for their ends.

A common extension of two places climbs while the parsed symbols are equal, and comes
down where they differ; at each level it passes a few symbols. Many extensions are
answered at once, one array operation for all that are on the same level.
"""

from __future__ import annotations

import numpy as np

#: Ways to sort symbols into left and right that are tried; the one that pairs most is taken.
TRIALS = 4


class _Level:
    """The sequence at one level, and how the next one above groups it."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        #: Index of each symbol's group above, the first member of each group (and the end), whether groups are blocks.
        self.group = self.first = None
        self.blocks = False

    def group_by(self, heads: np.ndarray, blocks: bool) -> np.ndarray:
        """Take the symbols at ``heads`` (a mask) as first members of groups; returns the first members."""
        self.first = np.append(np.flatnonzero(heads), len(heads))
        self.group = np.cumsum(heads) - 1
        self.blocks = blocks
        return self.first[:-1]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(40)


class Grammar:
    """The levels over ``symbols``, whole numbers >= 0 of which all >= ``marks`` occur once.

    The first and the last symbol must be such marks. Marks are never paired, so that no
    extension passes one; extensions are asked for between two marks only.
    """

    def __init__(self, symbols: np.ndarray, marks: int) -> None:
        level = _Level(symbols.astype(np.int64))
        self.levels = [level]
        name = top = int(symbols.max()) + 1
        number = 0
        while True:
            is_mark = (level.symbols >= marks) & (level.symbols < top)
            inner = np.sort((np.cumsum(is_mark) * name + level.symbols)[~is_mark])
            if not (inner[1:] == inner[:-1]).any():
                # No symbol occurs twice between two marks, so that nothing above could be equal.
                return
            if number % 2 == 0:
                level, name = self._compress_blocks(level, name)
            else:
                level, name = self._compress_pairs(level, name, is_mark, number)
            number += 1

    def _above(self, symbols: np.ndarray) -> _Level:
        self.levels.append(_Level(symbols))
        return self.levels[-1]

    def _compress_blocks(self, level: _Level, name: int) -> tuple[_Level, int]:
        s = level.symbols
        heads = level.group_by(np.append(True, s[1:] != s[:-1]), blocks=True)
        lengths = np.diff(level.first)
        above = s[heads].copy()
        long = lengths > 1
        if long.any():
            of, names = np.unique(above[long] * (int(lengths.max()) + 1) + lengths[long], return_inverse=True)
            above[long] = name + names
            name += len(of)
        return self._above(above), name

    def _compress_pairs(self, level: _Level, name: int, marks: np.ndarray, number: int) -> tuple[_Level, int]:
        s = level.symbols
        free = ~(marks[:-1] | marks[1:])
        best = None
        for trial in range(TRIALS):
            right = _mixed(s, number * TRIALS + trial) & np.uint64(1) == 1
            paired = ~right[:-1] & right[1:] & free
            if best is None or np.count_nonzero(paired) > np.count_nonzero(best):
                best = paired
        # A pair's second symbol is no head.
        heads = level.group_by(np.append(True, ~best), blocks=False)
        above = s[heads].copy()
        if best.any():
            at = np.flatnonzero(best)
            of, names = np.unique(s[at] * name + s[at + 1], return_inverse=True)
            above[level.group[at]] = name + names
            name += len(of)
        return self._above(above), name

    def extensions(self, left: np.ndarray, right: np.ndarray, forward: bool = True) -> np.ndarray:
        """For each pair of different places: how many symbols from there on are equal, both included.

        Without ``forward``, from there on to the left.
        """
        x, y = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        level_of = np.zeros(len(x), dtype=np.int64)
        here = np.arange(len(x))
        for number, level in enumerate(self.levels):
            # Pairs that are on this level: pass equal symbols until groups above are equal, or symbols differ.
            climb = []
            while len(here):
                here = here[self._equal(level, x, y, here)]
                up = self._may_climb(number, x, y, here, forward)
                climb.append(here[up])
                here = here[~up]
                self._pass(level, x, y, here, forward)
            here = np.concatenate(climb) if climb else here
            if not len(here):
                break
            x[here], y[here] = level.group[x[here]], level.group[y[here]]
            level_of[here] = number + 1
        for number in range(int(level_of.max(initial=0)) - 1, -1, -1):
            level = self.levels[number]
            here = np.flatnonzero(level_of > number)
            for z in (x, y):
                z[here] = level.first[z[here]] if forward else level.first[z[here] + 1] - 1
            level_of[here] = number
            while len(here):
                here = here[self._equal(level, x, y, here)]
                self._pass(level, x, y, here, forward)
        return x - left if forward else left - x

    @staticmethod
    def _equal(level: _Level, x: np.ndarray, y: np.ndarray, here: np.ndarray) -> np.ndarray:
        return level.symbols[x[here]] == level.symbols[y[here]]

    def _may_climb(self, number: int, x: np.ndarray, y: np.ndarray, here: np.ndarray, forward: bool) -> np.ndarray:
        level = self.levels[number]
        if level.group is None:
            return np.zeros(len(here), dtype=bool)
        a, b = x[here], y[here]
        group_a, group_b = level.group[a], level.group[b]
        edge = (lambda g: level.first[g]) if forward else (lambda g: level.first[g + 1] - 1)
        above = self.levels[number + 1].symbols
        return (edge(group_a) == a) & (edge(group_b) == b) & (above[group_a] == above[group_b])

    @staticmethod
    def _pass(level: _Level, x: np.ndarray, y: np.ndarray, here: np.ndarray, forward: bool) -> None:
        if level.blocks:
            # Equal symbols of two blocks: as many as the shorter rest has.
            a, b = x[here], y[here]
            if forward:
                step = np.minimum(level.first[level.group[a] + 1] - a, level.first[level.group[b] + 1] - b)
            else:
                step = np.minimum(a - level.first[level.group[a]], b - level.first[level.group[b]]) + 1
        else:
            step = 1
        x[here] += step if forward else -step
        y[here] += step if forward else -step
