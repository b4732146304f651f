"""NumPy kernels over the UTF-8 bytes of Arrow string columns.

Python string objects are never built for the bulk of a corpus: an Arrow batch
is cut into pieces of about ``PIECE`` bytes (a longer document is a piece of its
own), and words, hashes and shingles are computed for a whole piece at a time.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets of the rows in those bytes) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no row, and the rows' offsets among them."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, off)


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero, for hashes of substrings."""
    p = np.empty(len(values) + 1, np.uint64)
    p[0] = 0
    np.cumsum(values * powers(len(values))[0], out=p[1:])
    return p


def hash_spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans.  Equal strings have equal hashes wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a piece, with A-Z lower-cased, and the rows' offsets among them."""
    s, e, at = spans(~SPACE[data], off)
    return hash_spans(sums(BYTE_VALUE[LOWER[data] if lower else data]), s, e), at


def count_words(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(spans(~SPACE[data], off)[2])


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 3) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row with fewer words has its whole sequence as one, a row without words none."""
    h, at = words(data, off)
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        full = full * U(0xC2B2AE3D27D4EB4F) + mix(h[k : k + len(full)] + U(k + 1))
    full = mix(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            one = U(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = one * U(0xA0761D6478BD642F) + x
                yield mix(np.array([one + U(b - a)], np.uint64))
        else:
            yield full[:0]
