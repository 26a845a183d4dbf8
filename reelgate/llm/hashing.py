"""Vectorised hashing of the bytes, words and word n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that one vectorised step handles; keeps its arrays inside the caches.
STEP_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64

#: White space (fixed values): space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(table: np.ndarray, base: int, size: int) -> np.ndarray:
    while len(table) < size:
        step = _U(pow(base, len(table), 1 << 64))
        table = np.concatenate([table, table * step])
    return table


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverses
    _powers = _grown(_powers, int(_BASE), size)
    _inverses = _grown(_inverses, pow(int(_BASE), -1, 1 << 64), size)
    return _powers, _inverses


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finisher of a public 64-bit generator)."""
    values = values ^ (values >> _U(30))
    values = values * _U(0xBF58476D1CE4E5B9)
    values = values ^ (values >> _U(27))
    values = values * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power, from which every substring's hash follows by a difference."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever the bytes stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, taken in by eight bytes at a time.

    Unlike a polynomial modulo a power of two, it has no patterns that meet whatever the base. Each
    round takes the next eight bytes of the spans that have as many.
    """
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    loads = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    found = mixed(lengths.astype(np.uint64) * _BASE)
    todo = np.flatnonzero(lengths > 0)
    done = 0
    while len(todo):
        left = np.minimum(lengths[todo] - done, 8).astype(np.uint64)
        part = loads[starts[todo] + done] & (~_U(0) >> (_U(64) - left * _U(8)))
        found[todo] = mixed(found[todo] * _BASE + part)
        done += 8
        todo = todo[lengths[todo] > done]
    return found


def steps(texts: Sequence[bytes], size: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    first, held, total = 0, [], 0
    for number, text in enumerate(texts):
        if held and total + len(text) > size:
            yield first, held
            first, held, total = number, [], 0
        held.append(text)
        total += len(text)
    if held:
        yield first, held


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by a newline, and where each text starts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return data, np.concatenate([[0], np.cumsum(lengths)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of non-space bytes."""
    space = IS_SPACE[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` successive values, for every place where they begin."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for place in range(size):
        total = (total + hashes[place : place + count]) * _BASE
    return mixed(total)
