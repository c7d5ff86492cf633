"""Vectorised words and word shingles of Arrow string columns (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text is cut at white space.
STEP = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 1 << 64, 8, dtype=np.uint64, endpoint=False) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 2 * len(_powers)), _PRIME, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _cuts(data: np.ndarray, starts: np.ndarray):
    """Ranges of about STEP bytes that end at a text's end or at white space."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + STEP
        if hi < n:
            nearest = np.searchsorted(starts, hi)
            end = int(starts[nearest]) if nearest < len(starts) else n
            if end - hi > STEP:  # inside a long text
                while hi < end and not _SPACE[data[hi]]:
                    hi += 1
                end = min(hi, end)
            hi = end
        yield lo, min(hi, n)
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, words of each text)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    hashes, found = [], []
    for lo, hi in _cuts(data, offsets):
        part = data[lo:hi]
        if fold_case:
            part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[lo + 1 : hi]
        at = np.flatnonzero(inside)
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        flags = first[at]
        place = at - starts[np.cumsum(flags) - 1]
        terms = _BYTE[part[at]] * _power(int(place.max()) + 1)[place]
        hashes.append(mix64(np.add.reduceat(terms, np.flatnonzero(flags))))
        found.append(starts + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    hashes, found = np.concatenate(hashes), np.concatenate(found)
    counts = np.diff(np.searchsorted(found, offsets))
    return hashes, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int):
    """The sorted distinct shingle hashes of each text in turn.

    A text of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    at = 0
    for count in counts:
        words = hashes[at : at + count]
        at += count
        if count == 0:
            yield words
            continue
        k = min(width, int(count))
        total = np.full(count - k + 1, np.uint64(k), np.uint64)
        for j in range(k):
            total += words[j : count - k + 1 + j] * _PLACE[j % 8] ** np.uint64(1 + j // 8)
        yield np.unique(mix64(total))


def batches(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20):
    """Stretches [a, b) of texts of about ``limit`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    data, offsets = buffers(texts)
    for a, b in batches(data, offsets):
        own = offsets[a : b + 1]
        yield from shingles(*word_hashes(data[own[0] : own[-1]], own - own[0]), width)
