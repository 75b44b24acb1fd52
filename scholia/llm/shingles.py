"""Word shingles of texts as sorted arrays of hashes, for Arrow columns of texts.

A-Z count as a-z, words are separated by the white space of ASCII, a shingle is 5 words, or all words of a text with fewer.
Texts are worked on in groups of some PIECE bytes, a longer text in parts cut at white space, so the arrays that a task
needs beside its Arrow batch are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
PIECE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\r\x0b\x0c"]] = True
#: A value for each byte, the same for both cases of a letter.
_VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers below n of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b % (1 << 64), np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts that lie in raw one after the other, and the number of words of each text."""
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[last] - sums[first]) * down[first]
    h ^= h >> np.uint64(32)
    return h * _MIX, np.diff(np.searchsorted(first, bounds))


def parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end at white space."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and not (space := _SPACE[raw[end : end + PIECE]]).any():
            end += PIECE
        end = end + int(np.argmax(space)) if end < len(raw) else len(raw)
        yield raw[at:end]
        at = end


def sets(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text one after the other, and where each text's begin."""
    k = np.minimum(counts, WORDS)
    m = np.where(counts > 0, counts - k + 1, 0)
    bounds = np.append(0, np.cumsum(m))
    at = np.repeat(np.cumsum(counts) - counts - bounds[:-1], m) + np.arange(bounds[-1])
    own = np.repeat(k, m)
    s = own.astype(np.uint64)
    for j in range(WORDS):
        live = own > j
        x = (s[live] ^ h[at[live] + j]) * _MIX
        s[live] = x ^ (x >> np.uint64(29))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[bounds[:-1][m > 0]] = True
    return s[new], np.append(0, np.cumsum(new))[bounds]


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of rows of a column of texts: first row, row after the last, their shingles and where each row's begin."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + PIECE, "right")) - 1)
        raw = data[bounds[lo] : bounds[hi]]
        if len(raw) > PIECE:  # one long text
            hashes = [words(p, np.array([0, len(p)]))[0] for p in parts(raw)]
            h, counts = np.concatenate(hashes), np.array([sum(map(len, hashes))])
        else:
            h, counts = words(raw, bounds[lo : hi + 1] - bounds[lo])
        yield lo, hi, *sets(h, counts)
        lo = hi


def lists(values: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """values[first : first + size] for each first and size, as a column of long arrays."""
    ends = np.append(0, np.cumsum(sizes))
    at = np.repeat(firsts - ends[:-1], sizes) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[at].view(np.int64)))
