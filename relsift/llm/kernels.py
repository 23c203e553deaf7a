"""Numpy kernels over the bytes of Arrow string columns.

Texts are worked on where Arrow holds them, as one byte array with offsets, in
blocks of bounded size, so that no Python object is made per word and the
temporary arrays stay small however long a batch or a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; temporary arrays take some 60 bytes for each.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 1024

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: A 64-bit value for each byte value.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


class _Cache(dict):
    """A dict that travels to executors empty."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 8192)
        for name, m in (("up", _MULT), ("down", _MULT_INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its ``len + 1`` offsets; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def row_blocks(offsets: np.ndarray, most_bytes: int = BLOCK_BYTES, most_rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_rows`` rows and ``most_bytes`` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, and the index of each
    text's first word (``len(offsets)`` entries). Words never cross texts."""
    solid = ~IS_SPACE[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``len + 1`` prefix sums from which any substring's hash follows."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``, the same wherever the bytes stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in order, A-Z lower-cased, and each text's first word.

    The bytes are hashed in blocks that end at white space, so a long text needs
    memory for its words only."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        prefix = prefix_hash(low[base: ends[hi - 1]])
        out[lo:hi] = span_hash(prefix, starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out, first


def shingle_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words (``len - n + 1`` of them)."""
    m = len(word_hash) - n + 1
    total = np.zeros(m, np.uint64)
    for i in range(n):
        odd = np.array([2 * i + 1], np.uint64) * _MULT
        total += mix(word_hash[i: i + m] + odd) * odd
    return mix(total)


def sums_between(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i, empty ranges 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
