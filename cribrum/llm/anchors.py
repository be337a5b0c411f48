"""Numpy kernels over symbol sequences (bytes, or hashed words) inside Spark tasks.

A *symbol sequence* is a uint64 array.  Substrings are named by two polynomial
hashes modulo the prime 2**31 - 1 with bases of their own, read off prefix sums,
so that any range of a chunk gets its name (62 bits, scrambled) in constant
time.  Every window of ``width`` symbols has one *anchor*: the leftmost position
among its first ``choices`` ones whose ``gram``-symbol name has the least mixed
value.  Equal windows have equal anchors at equal offsets, so repeats need be
looked for among anchors only.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
PRIME = np.uint64((1 << 31) - 1)
_HALF = np.uint64(31)
_rng = np.random.default_rng(20240229)
BASES = [int(x) for x in _rng.integers(1 << 20, (1 << 31) - 2, 2)]
#: Two random codes below PRIME for each byte value.
BYTE_CODES = _rng.integers(1, (1 << 31) - 2, (2, 256)).astype(np.uint64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n at least."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        size = max(n, CHUNK + (1 << 16))
        table = np.ones(1, np.uint64)
        while len(table) < size:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), int(PRIME))) % PRIME])
        _tables[base] = table
    return table


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, not fully reduced: below 2**33 for any x."""
    return (x & PRIME) + (x >> _HALF)


def byte_halves(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_CODES[0][raw], BYTE_CODES[1][raw]


def word_halves(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return symbols & PRIME, (symbols >> np.uint64(32)) & PRIME


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Names:
    """Names of substrings of one chunk of symbols, given as two halves below 2**31."""

    def __init__(self, halves: tuple[np.ndarray, np.ndarray]):
        n = len(halves[0])
        self.prefix, self.inverse = [], []
        for codes, base in zip(halves, BASES):
            # Folded terms are below 2**32, so sums of up to 2**31 of them fit.
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_fold(codes * _powers(base, n)[:n]), out=sums[1:])
            self.prefix.append(sums)
            self.inverse.append(_powers(pow(base, -1, int(PRIME)), n + 1))

    def _half(self, h: int, start, stop) -> np.ndarray:
        # A difference of sums, folded twice, is below 2**31 + 2**3.
        part = _fold(_fold(self.prefix[h][stop] - self.prefix[h][start]))
        return part * self.inverse[h][start] % PRIME

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._half(0, start, stop) << _HALF) | self._half(1, start, stop))

    def all(self, length: int) -> np.ndarray:
        """The names of all substrings of this length, by start."""
        n = len(self.prefix[0]) - length
        return self.at(slice(0, n), slice(length, length + n)) if n > 0 else np.zeros(0, np.uint64)

    def order(self, length: int) -> np.ndarray:
        """Mixed values of all substrings of this length that only serve to choose among them."""
        n = len(self.prefix[0]) - length
        return mix(self._half(0, slice(0, n), slice(length, length + n))) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each i, from block-wise running minima of both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    inside = np.ones(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_symbols(raw: np.ndarray) -> np.ndarray:
    """One symbol a word, from at most CHUNK bytes at a time (more only within one word)."""
    parts, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + CHUNK)
        while stop < len(raw) and not (raw[stop] == 32 or 9 <= raw[stop] <= 13):
            stop += 1
        piece = raw[at:stop]
        starts, ends = word_spans(piece)
        names = Names(byte_halves(piece))
        parts.append(mix(names.at(starts, ends) + (ends - starts).astype(np.uint64)) | np.uint64(1))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def segments(lengths: list[int], width: int, limit: int = CHUNK) -> list[list[tuple[int, int, int]]]:
    """(document, start, stop) of symbol ranges, in groups of about ``limit`` symbols.

    Ranges of one long sequence overlap by width - 1 so that each window start
    lies in exactly one of them; sequences shorter than the width are left out.
    """
    groups, now, size = [], [], 0
    for k, n in enumerate(lengths):
        for start in range(0, n - width + 1, limit):
            stop = min(n, start + limit + width - 1)
            now.append((k, start, stop))
            size += stop - start
            if size >= limit:
                groups.append(now)
                now, size = [], 0
    return groups + [now] if now else groups


def window_anchors(sizes: np.ndarray, names: Names, width: int, choices: int, gram: int):
    """Anchors of all windows of a chunk made of sequences of the given sizes.

    Returns arrays: index of the sequence, anchor position, and first and last
    window start that has this anchor, all as positions in the chunk.
    """
    total = int(sizes.sum())
    order = names.order(gram)
    slots = np.uint64((1 << 24) - 1)
    order = (order & ~slots) | np.arange(len(order), dtype=np.uint64)
    least = (sliding_min(order, choices) & slots).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - width + 1
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    owner = np.repeat(np.arange(len(sizes)), counts)
    assert total < 1 << 24
    anchor = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return owner[first], anchor[first], starts[first], starts[last]


def union_runs(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open ranges; ranges that touch are one run."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]
