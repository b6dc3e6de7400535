"""Vectorised helpers that the text operators share inside Arrow tasks.

Everything here works on one block of texts at a time: the UTF-8 bytes of a
block in one ``uint8`` array with row offsets.  Spark deals the rows out; these
functions turn the bytes of a block into hashes without a Python loop over
characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a task looks at together; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C55)
_BASE_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The six ASCII white-space bytes that end a word.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64 (of the inverse base if asked), kept between calls."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _BASE_INVERSE if inverse else _BASE, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets (from 0); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most ``limit`` text bytes (or one row), each with its bytes and offsets."""
    data, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; differences of two of them hash the bytes between."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_BYTE_CODES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the byte spans [start, end); equal bytes hash alike wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start] + (end - start).astype(np.uint64))


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all k-byte grams, by start."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix_hash(data)
    return mix((sums[k:] - sums[:-k]) * powers(n, inverse=True))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by window start."""
    if len(x) < width:
        return x[:0]
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def rightmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each window's values stands (compared by their upper 40 bits; of equal ones, the last), by window start."""
    low = _U64((1 << 24) - 1)
    out = np.empty(max(0, len(x) - width + 1), np.int64)
    step = 1 << 23  # places of a step fit the lower bits, however long the text
    for a in range(0, len(out), step):
        part = x[a : a + step + width - 1]
        least = sliding_min((part | low) - np.arange(len(part), dtype=np.uint64), width)
        out[a : a + len(least)] = a + (low - (least & low)).astype(np.int64)
    return out


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every white-space separated word of a block, and each row's first word's index (n+1 values)."""
    inside = np.ones(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = at[(at > 0) & (at < len(data))]
    begins[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of a block, and each row's first word's index."""
    start, end, first = words(data, at)
    return span_hash(prefix_hash(ascii_lower(data)), start, end), first


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every row's word shingles, concatenated, and their offsets by row.

    A row with fewer words than ``width`` has its whole word sequence as its
    one shingle; a row without words has none.
    """
    hashed, first = word_hashes(data, at)
    counts = np.diff(first)
    rows = np.arange(len(counts))
    weight = powers(width + 1)
    total = max(0, len(hashed) - width + 1)
    rolled = np.zeros(total, dtype=np.uint64)
    for j in range(width):
        rolled += hashed[j : j + total] * weight[j]
    row_of = np.repeat(rows, counts)[:total]
    full = np.arange(total) + width <= first[row_of + 1]
    keys, owner = [mix(rolled[full])], [row_of[full]]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashed[first[r] : first[r + 1]]
        keys.append(mix(np.array([(own * weight[: len(own)]).sum(dtype=np.uint64) + _U64(len(own))], dtype=np.uint64)))
        owner.append(np.array([r]))
    key, row = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    if len(key):
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        key, row = key[fresh], row[fresh]
    return key, np.searchsorted(row, np.arange(len(counts) + 1))
