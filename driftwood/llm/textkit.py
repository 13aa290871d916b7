"""Vectorised work on the bytes of many texts at once: words, word hashes, shingles, winnowing.

Everything reads Arrow buffers, so no Python object is made for a word.  Hashes are 64-bit and keyed by fixed
seeds: equal bytes give equal hashes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
GRAM_BASE = U64(0x9FB21C651E98DF25)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words in the near-duplicate contracts: space and \x09 to \x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of the decontamination contract, after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about limit bytes; a longer row is its own run.  Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word (one more entry than documents)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    flag = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = flag.copy()
    first[1:] &= ~flag[:-1] | edge[1:-1]
    last = flag.copy()
    last[:-1] &= ~flag[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_code(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    code = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * up, out=code[1:])
    return code


def span_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from their prefix code; equal bytes, equal hash."""
    _, down = powers(len(code))
    return mix((code[ends] - code[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_code(data), starts, ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, ignoring document ends (see inside())."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= GRAM_BASE
        out += hashes[j : j + n]
    return mix(out + U64(k))


def grams_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hashes that grams() has at these positions."""
    out = hashes[at]
    for j in range(1, k):
        out = out * GRAM_BASE + hashes[at + j]
    return mix(out + U64(k))


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n runs of k words lie within one document; bounds from words()."""
    ok = np.ones(n, bool)
    for j in range(1, k):
        at = bounds[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document and the bounds of each document in them.

    A document with fewer words than size has its whole word sequence as its one shingle; without words, none.
    """
    data = LOWER[data]
    starts, ends, bounds = words(data, offs, NOT_BLANK)
    h = word_hashes(data, starts, ends)
    g = grams(h, size)
    parts, sizes = [], np.zeros(len(offs), np.int64)
    for i in range(len(offs) - 1):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= size:
            own = np.sort(g[a : b - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = grams(h[a:b], b - a)
        else:
            continue
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(sizes)
