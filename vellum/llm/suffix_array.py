"""Maximal repeats around an anchor by the common-prefix interval tree of an enhanced suffix array.

The array holds the suffixes that start at the anchor's occurrences, in order, with the lengths of their neighbours'
common prefixes and what stands before each. A repeat that has the anchor in it is a common prefix and a common
extension to the left. A stack-scan of the prefix lengths gives the tree's intervals; in each, a second scan of the
members by what stands before them gives the sets that extend equally far to the left and no further. Such a set is a
maximal repeat if its members go on differently on the right, i.e. aren't all in one child of the interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(height, first, last) of each interval of the tree over prefix lengths of neighbours, if its height is `least` or more; inner ones first."""
    stack: list[tuple[int, int]] = []
    for i, h in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > h:
            height, first = stack.pop()
            if height >= least:
                yield height, first, i
        if h >= 0 and (not stack or stack[-1][0] < h):
            stack.append((h, first))


def maximal_repeats(before: list[bytes], after: list[bytes], least: int, lcp: list[int] | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """(l, h, members): each maximal repeat of `least` bytes or more, with all its members.

    after: the different suffixes in order (equal ones may follow each other); before: what precedes each, reversed. The
    repeat goes from l bytes before to h bytes behind the anchor of each member. lcp: of neighbours, if known.
    """
    if lcp is None:
        lcp = [common(a, b) for a, b in zip(after, after[1:], strict=False)]
    longest = max(map(len, before), default=0)
    for h, first, last in intervals(lcp, max(0, least - longest)):
        child, children = 0, {first: 0}
        for i in range(first, last):
            child += lcp[i] == h
            children[i + 1] = child
        # those that can't reach far enough to the left take no part
        own = [i for i in range(first, last + 1) if len(before[i]) >= least - h]
        own.sort(key=before.__getitem__)
        left = [common(before[a], before[b]) for a, b in zip(own, own[1:], strict=False)]
        for l, a, b in intervals(left, max(0, least - h)):
            members = own[a : b + 1]
            if any(children[m] != children[members[0]] for m in members):
                yield l, h, members


def reach(before: list[bytes], after: list[bytes], least: int, lcp: list[int] | None = None) -> dict[int, tuple[int, int]]:
    """For each member of a maximal repeat how far its repeats go to the left and to the right; all hold the anchor, so their union is one range."""
    out: dict[int, tuple[int, int]] = {}
    for l, h, members in maximal_repeats(before, after, least, lcp):
        for m in members:
            a, b = out.get(m, (0, 0))
            out[m] = max(a, l), max(b, h)
    return out


def neighbours(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The length, up to `width`, of the common prefix of each string with the next, for strings laid one behind the other."""
    size = np.minimum(np.diff(offsets), width)
    held = np.append(data, np.zeros(width, np.uint8))
    out = np.zeros(max(len(size) - 1, 0), np.int64)
    for a in range(0, len(out), 2048):
        b = min(a + 2048, len(out))
        rows = held[offsets[a : b + 1, None] + np.arange(width)]
        differ = rows[1:] != rows[:-1]
        most = np.minimum(size[a:b], size[a + 1 : b + 1])
        out[a:b] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), most)
    return out
