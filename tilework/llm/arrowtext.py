"""Text columns of Arrow batches as numpy arrays: words and shingles of many texts at once, inside tasks.

A batch's texts lie one after the other in one UTF-8 buffer. Word boundaries, word hashes (prefix sums of a
polynomial modulo 2**64) and shingle hashes are computed over the whole buffer, in slices of bounded size, so the cost
a text is a few numpy calls rather than a Python loop over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return splitmix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = randoms(256, 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C17 | 3  # odd and 3 modulo 4
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        inverse = pow(_P, -1, 1 << 64)
        _POWERS[:] = []
        for base in (_P, inverse):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty. offsets has a row more than the column."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of a single longer text."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def words(data: np.ndarray, offsets: np.ndarray, breaks: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and first[r] = number of words before row r (rows + 1 long).

    breaks: bytes at which rows end too, such as a newline (they are white space anyway)."""
    n = len(data)
    space = _IS_SPACE[data]
    begin, end = ~space, ~space
    begin[1:] &= space[:-1] | False
    end[:-1] &= space[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begin[edge] |= ~space[edge]
    end[edge - 1] |= ~space[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word, A-Z taken as a-z."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_LOWER[data] * power[:-1], out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each row's k-word shingles, in order, with repeats; a row of fewer words has its whole
    sequence as its one shingle, a row without words has none."""
    n, counts = len(hashes), np.diff(first)
    out = hashes.copy()
    size = max(0, n - k + 1)
    acc = hashes[:size].copy()
    for j in range(1, k):
        acc = splitmix(acc) * np.uint64(_P) + hashes[j : j + size]
    out[:size] = splitmix(acc)
    keep = np.ones(n, dtype=bool)
    per = np.maximum(counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), counts)
    keep = (np.arange(n) - first[:-1][row]) < per[row]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        value = 0
        for h in hashes[first[r] : first[r + 1]]:
            value = (value * _P + int(h) + 1) & _MASK
        out[first[r]] = splitmix(np.array([value ^ int(counts[r])], dtype=np.uint64))[0]
    return out[keep], np.concatenate([[0], np.cumsum(per)])


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, rows not being told apart."""
    size = max(0, len(hashes) - k + 1)
    acc = hashes[:size].copy()
    for j in range(1, k):
        acc = splitmix(acc) * np.uint64(_P) + hashes[j : j + size]
    return splitmix(acc)


def run_keys(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """int64 hash of the words from each start on, as many as its length says."""
    power, inverse = _powers(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    return splitmix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64)).view(np.int64)


def sets(shingle: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each row's distinct shingles, sorted within the row."""
    parts = [np.unique(shingle[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else shingle[:0]), np.concatenate([[0], np.cumsum(sizes)])


def minhashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, functions: int, seed: int) -> np.ndarray:
    """(rows, functions) of uint32: the least of each hash function over values[start:stop] of each row, with or without
    repeats (empty row: all ones)."""
    out = np.full((len(starts), functions), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(stops > starts)
    if not len(full):
        return out
    low = np.append((values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32), np.uint32(0))
    r = randoms(2 * functions, seed)
    edges = np.stack([starts[full], stops[full]], axis=1).ravel()
    for j in range(functions):
        x = (low ^ np.uint32(int(r[2 * j]) & 0xFFFFFFFF)) * np.uint32((int(r[2 * j + 1]) & 0xFFFFFFFF) | 1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        out[full, j] = np.minimum.reduceat(x, edges)[::2]
    return out


def set_keys(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set as two int64 arrays (order-free sums of two mixes); empty sets: zeros."""
    rows = len(first) - 1
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        mixed = splitmix(values ^ np.uint64(salt * 0x10001))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64) if rows else np.empty(0, np.int64))
    return out[0], out[1]


def fold(columns: np.ndarray, tag: int) -> np.ndarray:
    """One int64 a row from several columns of numbers, and from tag."""
    acc = np.full(len(columns), tag * 2654435761 + 1, dtype=np.uint64)
    for j in range(columns.shape[1]):
        acc = splitmix(acc) + columns[:, j].astype(np.uint64) * np.uint64(_P)
    return splitmix(acc).view(np.int64)
