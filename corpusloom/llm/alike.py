"""Keys within two wrong characters of each other, looked for by arrays inside tasks: hashed pieces and counts of letters, both exact
bounds. `rare_classes` of lines.py uses them where what is sent to the tasks is small."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WRONG = 2
#: A key is looked up by its ends at each length within WRONG, and by the middle, moved by what one wrong character can move it while
#: the other makes up the length.
PLACES = [(by, kind, 0) for by in range(-WRONG, WRONG + 1) for kind in (0, 1)] + [(by, 2, d) for by in range(-WRONG, WRONG + 1) for d in (-1, 0, 1) if abs(by + d) <= 1]
#: So many pairs are looked at together.
PAIRS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class Keys(NamedTuple):
    """The keys of a batch, as bytes behind each other."""

    data: np.ndarray
    first: np.ndarray  #: number of each key's first character
    length: np.ndarray  #: in characters
    start: np.ndarray  #: byte at which each character begins, and the end
    sums: np.ndarray  #: of the bytes before, times powers of _BASE
    back: np.ndarray  #: powers of the inverse of _BASE
    group: np.ndarray


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def keys_of(key: pa.Array, group: np.ndarray) -> Keys:
    key = key.cast(pa.large_binary())
    ends = np.frombuffer(key.buffers()[1], np.int64)[key.offset : key.offset + len(key) + 1]
    data = np.frombuffer(key.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begins = np.append((data & 0xC0) != 0x80, True)
    begins[ends] = True
    start = np.flatnonzero(begins)
    at = np.searchsorted(start, ends)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(data * _powers(_BASE, len(data)), dtype=_U, out=sums[1:])
    return Keys(data, at[:-1], np.diff(at), start, sums, _powers(pow(_BASE, -1, 2**64), len(data) + 1), group.astype(np.int64).view(_U))


def _cell(k: Keys, length: np.ndarray, kind: int, moved: int) -> np.ndarray:
    """Hash of group, length, kind and piece: a third from the beginning (0), from the end (1), or after the first, moved (2)."""
    g = np.maximum(0, (length - 2) // 3)
    a = {0: np.zeros_like(g), 1: k.length - g, 2: np.clip(g + moved, 0, k.length)}[kind]
    a, z = k.start[k.first + a], k.start[k.first + np.minimum(a + g, k.length)]
    x = (k.sums[z] - k.sums[a]) * k.back[a] + k.group * _U(3)
    for more in (length.astype(np.int64).view(_U) * _U(4) + _U(kind), _U(0)):  # mixed, so that equal sums are equal pieces only
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9) + more
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def cells(k: Keys) -> np.ndarray:
    """The cells in which each key lies, three columns."""
    return np.stack([_cell(k, k.length, kind, 0) for kind in (0, 1, 2)], 1)


def lookups(k: Keys) -> Iterator[np.ndarray]:
    """For each of PLACES a cell of each key, in which keys within WRONG characters can lie; all that do lie in one of them."""
    for by, kind, moved in PLACES:
        yield _cell(k, k.length + by, kind, moved)


def letters(k: Keys) -> np.ndarray:
    """Counts of the characters in 32 kinds, so that a count that is one more or less changes one bit: WRONG wrong characters change
    at most 2 * WRONG bits."""
    last = k.data[k.start[1:] - 1] & 31
    row = np.repeat(np.arange(len(k.first)), k.length)
    held = np.bincount(row * 32 + last, minlength=32 * len(k.first)).reshape(-1, 32).astype(_U) & _U(3)
    return np.bitwise_or.reduce((held ^ (held >> _U(1))) << np.arange(0, 64, 2, dtype=_U), 1)


class Sorted(NamedTuple):
    """Cells in order, and a table of bits by which most others are passed over."""

    cells: np.ndarray
    some: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, values: np.ndarray) -> Sorted:
        values = np.sort(values)
        bits = max(10, len(values).bit_length() + 3)
        some = np.zeros(1 << bits, bool)
        some[values >> _U(64 - bits)] = True
        return cls(values, some, _U(64 - bits))

    def met(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, end) of the wanted cells that are among these."""
        row = np.flatnonzero(self.some[wanted >> self.shift])
        begin, end = np.searchsorted(self.cells, wanted[row]), np.searchsorted(self.cells, wanted[row], "right")
        there = end > begin
        return row[there], begin[there], end[there]


def pairs(k: Keys, there: Sorted, owner: np.ndarray, owner_letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, owner), once each: the keys and the owners of cells in which they are looked up, as far as their letters allow at most
    WRONG wrong characters."""
    own, rows, owners = letters(k), [], []
    for wanted in lookups(k):
        row, begin, end = there.met(wanted)
        upto = np.cumsum(end - begin)
        i = 0
        while i < len(row):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS)))
            n = (end - begin)[i:j]
            r = np.repeat(row[i:j], n)
            o = owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[i:j], n)]
            near = np.bitwise_count(own[r] ^ owner_letters[o]) <= 2 * WRONG
            rows.append(r[near])
            owners.append(o[near])
            i = j
    both = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]) * max(1, len(owner_letters)) + np.concatenate([*owners, np.zeros(0, np.int64)]))
    return both // max(1, len(owner_letters)), both % max(1, len(owner_letters))
