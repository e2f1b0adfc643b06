"""Suffix sort by hashes: common extensions of two suffixes by binary search over prefix polynomial hashes.

With prefix sums of byte values times powers of an odd base, the hash of any span is one subtraction and one
product.  Two suffixes are compared by halving steps over spans of equal hash, so a comparison takes
logarithmic time in the extension and one byte after it.  A bottom-up mergesort merges neighbouring runs of
all groups at once: every suffix finds its place in the other run by binary search with this comparison.

Afterwards every pair of neighbours is checked on its bytes.  If equal hashes of unlike spans had
misplaced anything, neighbours would be out of order; such a sort is done again on the bytes.
"""

from __future__ import annotations

import numpy as np

from residua.llm.pieces import gather
from residua.llm.words import _BYTE_VALUES, _BYTES

_U = np.uint64
CHECKED = 1 << 15  # suffixes whose bytes are laid out at once


class PrefixHashes:
    """Hashes of all spans of some bytes.  ``bits`` keeps fewer bits of a hash (for tests of collisions)."""

    def __init__(self, data: np.ndarray, bits: int = 64) -> None:
        self.data = data
        up, self.down = _BYTES.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE_VALUES[data] * up[:-1], out=self.sums[1:])
        self.shift = _U(64 - bits)

    def span(self, start: np.ndarray, size: int) -> np.ndarray:
        return ((self.sums[start + size] - self.sums[start]) * self.down[start]) >> self.shift

    def extension(self, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of the suffixes at i and j, up to ``limit`` bytes, which both have."""
        length = np.zeros(len(i), np.int64)
        step = 1 << max(limit.bit_length() - 1, 0)
        while step:
            fits = np.flatnonzero(length + step <= limit)
            a, b = i[fits] + length[fits], j[fits] + length[fits]
            length[fits[self.span(a, step) == self.span(b, step)]] += step
            step >>= 1
        return length

    def before(self, i: np.ndarray, j: np.ndarray, limit: int, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at i comes before that at j; equal ones give ``ties``."""
        length = self.extension(i, j, limit)
        short = length < limit
        out = ties.copy()
        at = np.flatnonzero(short)
        out[at] = self.data[i[at] + length[at]] < self.data[j[at] + length[at]]
        return out


def _merged(hashes: PrefixHashes, suffix: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """``order``, numbers of suffixes by group, in order of the suffixes inside each group; ``begin`` and ``end``
    are the borders of the group of every place."""
    place, run = np.arange(len(order)), 1
    longest = int((end - begin).max(initial=0))
    while run < longest:
        at = np.flatnonzero(end - begin > run)  # places in groups of more than one run
        offset = place[at] - begin[at]
        number = offset // run
        lo = begin[at] + (number ^ 1) * run
        hi = np.minimum(lo + run, end[at])
        start, right = np.minimum(lo, hi), number % 2 == 1
        lo = start.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            middle = (lo[todo] + hi[todo]) >> 1
            goes = hashes.before(suffix[order[middle]], suffix[order[at[todo]]], limit, right[todo])  # of equals the left run comes first
            lo[todo[goes]] = middle[goes] + 1
            hi[todo[~goes]] = middle[~goes]
            todo = todo[lo[todo] < hi[todo]]
        moved = begin[at] + (number // 2) * 2 * run + offset % run + (lo - start)
        out = order.copy()
        out[moved] = order[at]
        order, run = out, run * 2
    return order


def _bytes_at(data: np.ndarray, suffix: np.ndarray, limit: int) -> np.ndarray:
    return data[gather(suffix, np.full(len(suffix), limit, np.int64))].reshape(len(suffix), limit)


def sorted_suffixes(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, limit: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (numbers into ``suffix``) by group and then by their next ``limit`` bytes, and for each
    place whether its suffix equals the one before it in its group.  Every suffix has ``limit`` bytes."""
    order = np.argsort(group, kind="stable")
    held = group[order]
    new = np.ones(len(order), bool)
    new[1:] = held[1:] != held[:-1]
    edge = np.append(np.flatnonzero(new), len(order))
    size = np.diff(edge)
    begin, end = np.repeat(edge[:-1], size), np.repeat(edge[1:], size)
    hashes = PrefixHashes(data, bits)
    number = _merged(hashes, suffix, order, begin, end, limit)
    met = np.zeros(len(order), bool)
    met[number] = True
    if not met.all():
        return _by_bytes(data, suffix, group, limit)
    same = np.zeros(len(order), bool)
    inside = ~new
    for lo in range(0, len(order), CHECKED):  # neighbours, on their bytes
        hi = min(lo + CHECKED, len(order))
        first = max(lo - 1, 0)
        rows = _bytes_at(data, suffix[number[first:hi]], limit)
        a, b = rows[:-1], rows[1:]
        unlike = a != b
        differs = unlike.any(1)
        at = unlike.argmax(1)
        steps = np.arange(len(a))
        rising = ~differs | (a[steps, at] < b[steps, at])
        wanted = inside[first + 1 : hi]
        if (wanted & ~rising).any():
            return _by_bytes(data, suffix, group, limit)
        same[first + 1 : hi] = wanted & ~differs
    return number, same


def _by_bytes(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the bytes alone, as big-endian words."""
    rows = np.zeros((len(suffix), -(-limit // 8) * 8), np.uint8)
    rows[:, :limit] = _bytes_at(data, suffix, limit)
    words = rows.view(">u8").astype(_U)
    order = np.lexsort((*words.T[::-1], group))
    same = np.zeros(len(order), bool)
    same[1:] = (words[order[1:]] == words[order[:-1]]).all(1) & (group[order[1:]] == group[order[:-1]])
    return order, same
