"""Burrows-Wheeler transform and common prefixes of many short strings, column by column."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# symbols: 0 stands before the first byte of a string, a byte b is b + 1
_DONE = 0


def _least(lcp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The minimum of each span [begin, end); spans may overlap."""
    order = np.argsort(-begin, kind="stable")
    # going down, what lies between two spans is a single element for reduceat
    pairs = np.stack([begin[order], end[order]], axis=1).ravel()
    found = np.empty(len(begin), dtype=lcp.dtype)
    found[order] = np.minimum.reduceat(lcp, pairs)[::2]
    return found


def collection_bwt(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The transform of all strings (each with an end mark of its own) and their common prefixes.

    Round j inserts, for every string that has j bytes, the suffix of length j. Its place
    follows from the place of the suffix one byte shorter: suffixes that begin with the same byte
    stand in the order of what follows it. The common prefix with a neighbour of the same
    first byte is one more than the least common prefix between the two shorter suffixes.
    Strings must be shorter than 255 bytes.
    """
    count = len(strings)
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=count)
    ends = np.cumsum(lengths)

    def symbol(owner: np.ndarray, length: int) -> np.ndarray:
        """What stands before the suffixes of this length."""
        more = lengths[owner] > length
        found = np.zeros(len(owner), dtype=np.uint16)
        found[more] = data[ends[owner[more]] - length - 1].astype(np.uint16) + 1
        return found

    active = np.arange(count)
    place = np.arange(count)
    bwt = symbol(active, 0)
    lcp = np.zeros(count + 1, dtype=np.uint8)  # the last entry ends the final span
    length = 0
    while True:
        goes_on = lengths[active] > length
        active, place = active[goes_on], place[goes_on]
        if not len(active):
            return bwt, lcp[:-1]
        length += 1
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), dtype=np.int64)
        rank[order] = np.arange(len(bwt))
        at = rank[place]
        mine = bwt[place]
        before, after = order[at - 1], order[np.minimum(at + 1, len(bwt) - 1)]
        low, high = np.zeros(len(at), dtype=np.uint8), np.zeros(len(at), dtype=np.uint8)
        alike = (at > 0) & (bwt[before] == mine)
        if alike.any():
            low[alike] = _least(lcp, before[alike] + 1, place[alike] + 1) + 1
        alike = (at + 1 < len(bwt)) & (bwt[after] == mine)
        if alike.any():
            high[alike] = _least(lcp, place[alike] + 1, after[alike] + 1) + 1
        new = count + at - int(np.searchsorted(bwt[order], 1))
        total = len(bwt) + len(new)
        old = np.ones(total, dtype=bool)
        old[new] = False
        grown, prefixes = np.empty(total, dtype=np.uint16), np.zeros(total + 1, dtype=np.uint8)
        grown[old], grown[new] = bwt, symbol(active, length)
        prefixes[:-1][old] = lcp[:-1]
        prefixes[new + 1] = high
        prefixes[new] = low
        prefixes[-1] = 0
        bwt, lcp, place = grown, prefixes, new


def repeated_windows(
    strings: Sequence[bytes], size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, string number and offset of every substring of ``size`` bytes that occurs twice."""
    bwt, lcp = collection_bwt(strings)
    count = len(strings)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=count)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), dtype=np.int64)
    rank[order] = np.arange(len(bwt))
    rank += count - int(np.searchsorted(bwt[order], 1))
    owner = np.full(len(bwt), -1, dtype=np.int64)
    offset = np.zeros(len(bwt), dtype=np.int64)
    active, place = np.arange(count), np.arange(count)
    length = 0
    # the way back: from each end mark to ever longer suffixes
    while True:
        goes_on = lengths[active] > length
        active, place = active[goes_on], rank[place[goes_on]]
        if not len(active):
            break
        length += 1
        if length >= size:
            owner[place] = active
            offset[place] = lengths[active] - length
    long = lcp >= size
    member = long.copy()
    member[:-1] |= long[1:]
    group = np.cumsum(~long)
    return group[member], owner[member], offset[member]
