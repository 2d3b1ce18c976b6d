"""Words of a batch of texts and their hashes, with numpy over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
STEPS = (U64(0xC2B2AE3D27D4EB4F), U64(0xFF51AFD7ED558CCD))

_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and n + 1 offsets; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 1_000_000):
    """The rows of ``batch`` in slices of about ``most`` bytes of the text column: the
    memory of numpy work does not follow Arrow's batch size."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = lengths[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(lengths, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 20)
        inverse = pow(int(BASES[base]), -1, 1 << 64)
        up, down = np.full(size, BASES[base]), np.full(size, U64(inverse))
        up[0] = down[0] = 1
        have = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: byte ranges, document numbers, hashes."""

    def __init__(self, column, lower: bool = False):
        self.data, self.offsets = utf8(column)
        data = self.data
        word = ~_blank[data]
        edge = np.empty(len(data) + 1, bool)
        edge[1:] = True
        if len(data):
            edge[0] = word[0]
            edge[1:-1] = word[1:] != word[:-1]
            edge[-1] = word[-1]
        # a document's border also ends a word
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        touching = inner[word[inner] & word[inner - 1]] if len(inner) else inner
        touching = np.unique(touching)
        marks = np.flatnonzero(edge) if len(data) else np.zeros(0, np.int64)
        starts, ends = marks[0::2], marks[1::2]
        if len(touching):
            starts, ends = np.sort(np.concatenate([starts, touching])), np.sort(np.concatenate([ends, touching]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, self.offsets)      # first word of each document, and the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), self.counts)
        self.text = _lower[data] if lower else data

    def hashes(self, base: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, mixed."""
        up, down = _power_tables(len(self.text), base)
        sums = np.empty(len(self.text) + 1, U64)
        sums[0] = 0
        np.cumsum((self.text.astype(U64) + U64(1)) * up[:len(self.text)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def windows(self, hashes: np.ndarray, size: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of each ``size`` consecutive words of one document, and the
        number of the window's first word."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1:])
        rolled = hashes[at].copy()
        for k in range(1, size):
            rolled *= STEPS[base]
            rolled += hashes[at + k]
        return mix(rolled), at


def runs_cover(at: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask of the ``total`` places covered by [a, a + size) for any a of ``at``."""
    steps = np.bincount(at, minlength=total + 1) - np.bincount(at + size, minlength=total + 1)
    return np.cumsum(steps[:total]) > 0
