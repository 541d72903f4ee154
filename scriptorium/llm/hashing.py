"""Array kernels that run inside tasks: byte windows, words and word shingles of Arrow text columns.

All of them work on the concatenated UTF-8 bytes of a slice of documents, so that the cost of a numpy
call is shared by many short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15  # multiplier of the rolling hash (odd, so it has an inverse modulo 2^64)
_INVERSE = pow(_ODD, -1, 1 << 64)
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        out[1:] = np.uint64(base)
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Rolling-hash prefixes of a sequence of 64-bit codes; feed to ``span_hash``."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(_ODD, len(codes)), out=out[1:])
    return out


def span_hash(prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of every ``[start, end)``; equal contents give equal hashes wherever they stand."""
    h = (prefixes[end] - prefixes[start]) * powers(_INVERSE, len(prefixes))[start]
    return mix(h)


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _CODES[data]


def slices(column: pa.Array | pa.ChunkedArray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of texts of about ``limit`` bytes; null counts as empty.

    A text longer than the limit forms a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of every word of lower-cased (A-Z) texts; words are runs without ASCII white space."""
    start, end, row = word_spans(data, offsets)
    return span_hash(prefix_sums(_CODES[_LOWER[data]]), start, end), row


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of every word."""
    space = _SPACE[data]
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1] | False
    last[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # a text's first byte starts a word whatever stands before it
    first[inner] |= ~space[inner]
    last[inner - 1] |= ~space[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of the distinct word shingles of every text, sorted by row and hash.

    A text of fewer words than ``size`` has its whole sequence as its one shingle; one without words has none.
    """
    h, row = words(data, offsets)
    n_rows = len(offsets) - 1
    count = np.bincount(row, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    sums = prefix_sums(h)
    at = np.arange(len(h))
    whole = at[: max(len(h) - size + 1, 0)]
    whole = whole[row[whole] == row[whole + size - 1]] if len(whole) else whole
    short = np.flatnonzero((count > 0) & (count < size))
    start = np.concatenate((whole, begin[short]))
    end = np.concatenate((whole + size, begin[short] + count[short]))
    keys, owner = span_hash(sums, start, end), row[start] if len(start) else np.zeros(0, np.int64)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    if len(keys):
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
        keys, owner = keys[new], owner[new]
    return keys, owner
