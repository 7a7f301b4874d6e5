"""Numpy helpers over Arrow text columns, shared by the training-data operators.

A batch of texts is one ``uint8`` buffer plus document offsets. Words are the
maximal runs of bytes outside ``SPACES``; hashes are polynomials mod 2**64
taken from prefix sums, so hashing a batch is a handful of array passes.
Everything here runs inside Spark tasks on bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of every word contract: space and bytes 9 to 13.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

#: Bytes handled at once; arrays of this length stay near the CPU caches.
BLOCK = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64 (kept and grown per process)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 2**64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the entropy of x over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0]: offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges of about ``size`` bytes (one document at least)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and word counts per document."""
    n_docs = len(offsets) - 1
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(n_docs, np.int64)
    inside = ~IS_SPACE[buf]
    start, last = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    first, final = offsets[:-1][filled], offsets[1:][filled] - 1
    start[first] = inside[first]
    last[final] = inside[final]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    return s, e, np.diff(np.searchsorted(s, offsets))


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [s, e)."""
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[buf] * powers(_BASE, n), out=total[1:])
    return mix((total[e] - total[s]) * inverse_powers(_BASE, n + 1)[s] + (e - s).astype(np.uint64))


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from every position (n - k + 1 of them)."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[buf] * powers(_BASE, len(buf)), out=total[1:])
    return mix((total[k:] - total[:n]) * inverse_powers(_BASE, n))


def sequence_hashes(items: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """A 64-bit hash of the k items from every position (n - k + 1 of them)."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = items[:n].copy()
    for j in range(1, k):
        out *= np.uint64(base)
        out += items[j: j + n]
    return mix(out)


def starts_within(counts: np.ndarray, k: int) -> np.ndarray:
    """Positions (over all items of consecutive documents) from which k items stay in one document."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(total) + k <= ends)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Boolean mask of length n: positions inside some [start, start + k)."""
    delta = np.bincount(starts, minlength=n + 1) - np.bincount(starts + k, minlength=n + 1)
    return np.cumsum(delta[:n]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


class Index(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n
