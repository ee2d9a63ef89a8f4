"""Vectorised scanning of Arrow text columns: words, lines and their 64-bit hashes, without a Python object per word.

A chunk is a run of rows of one Arrow batch. Its texts lie back to back in one byte buffer; row i has the bytes
offsets[i]:offsets[i + 1]. Words are maximal runs of bytes other than space and 0x09-0x0D, which for UTF-8 text are
the matches of ``[^\\x20\\x09-\\x0D]+``. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES_LOWER = _CODES[LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, 2 * CHUNK_BYTES)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Chunk:
    """Rows lo:hi of a batch, with the bytes of their texts and lazily computed words."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.rows = hi - lo
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of every word."""
        if self._words is None:
            self._words = self.runs(~SPACE[self.data])
        return self._words

    def runs(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of every run of bytes that are `solid` (one flag for each byte) within a row."""
        n = len(solid)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        first[edges] = solid[edges]
        last[edges - 1] = solid[edges - 1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, self.row_of(start)

    def prefix_hash(self, lower: bool) -> np.ndarray:
        """Prefix sums from which hash_spans() takes the hash of any span."""
        up, _ = _power_table(len(self.data) + 1)
        codes = (_CODES_LOWER if lower else _CODES)[self.data] * up[: len(self.data)]
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes, out=out[1:])
        return out

    def hash_spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _power_table(len(self.data) + 1)
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a text column in chunks of about `size` bytes; a longer text is a chunk of its own."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def window_hashes(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each position on, position) for the windows that lie within one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = mix(total + hashes[i : i + n]) if k <= 2 else total * np.uint64(_BASE) + hashes[i : i + n]
    inside = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(total[inside]), inside
