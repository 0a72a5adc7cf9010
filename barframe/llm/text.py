"""Word and shingle hashing over whole Arrow batches of UTF-8 text.

Everything here runs inside a task on one batch at a time.  The work is laid out over the byte
buffer of the batch, so no Python loop visits a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.  Bounds the scratch arrays (about 60 bytes for each of these).
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, np.uint64(inverse), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_TABLE: list = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLE or len(_TABLE[0][0]) < n:
        _TABLE[:] = [_powers(max(n, SLICE_BYTES + 1))]
    return _TABLE[0]


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES; a longer row makes a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each row after lower-casing A-Z.

    Returns the hashes of all rows in order and, for each row, the index of its first one
    (with one more entry at the end).
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    n = end - begin
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    chars = _LOWER[data[begin:end]]
    inside = ~_SPACE[chars]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[1:] > offsets[:-1]] - begin  # a word never runs on into the next row
    starts[rows] = inside[rows]
    begins = np.flatnonzero(starts)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | starts[1:]
    ends = np.flatnonzero(stops) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    value = (sums[ends] - sums[begins]) * down[begins]
    hashes = mix(value ^ (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(begins, offsets - begin).astype(np.int64)


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside each row, with the row of each run's first entry."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix(out * _BASE + words[k : len(words) - n + 1 + k])
    row_end = np.repeat(first[1:], np.diff(first))[: len(out)]  # where each word's row ends
    keep = np.arange(len(out)) + n <= row_end
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[np.minimum(first, len(out))].astype(np.int64)
