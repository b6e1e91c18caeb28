"""Vectorised text kernels for Arrow batches: words, hashes of byte spans, sums by document.

A batch of texts is one flat byte array with document offsets. Hashes of any span come from a prefix sum of a
polynomial modulo 2**64 over random byte codes, so all words, windows and lines of a batch are hashed without a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: 0 white space, 1 letters and digits (and all bytes of other characters), 2 the rest
CLASS = np.full(256, 2, np.uint8)
CLASS[SPACE] = 0
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

CODES = mix(np.arange(256))
BASE = int(mix(np.array([977]))[0]) | 5
INVERSE = pow(BASE, -1, 1 << 64)
#: positions are handled by so many at a time, so that work arrays beyond one long per position stay small
CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. CHUNK-1 of the base, and of its CHUNK-th power: enough for positions below 2**32."""
    if base not in _tables:
        _tables[base] = _powers(base, CHUNK), _powers(pow(base, CHUNK, 1 << 64), 1 << 16)
    return _tables[base]


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64."""
    low, high = tables(base)
    return low[at & (CHUNK - 1)] * high[at >> 16]


class SpanHash:
    """Hashes of spans of a sequence of 64-bit codes; with a ``table``, of the codes that it gives the members."""

    def __init__(self, codes: np.ndarray, table: np.ndarray | None = None):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        low, high = tables(BASE)
        for lo in range(0, len(codes), CHUNK):
            part = codes[lo : lo + CHUNK] if table is None else table.take(codes[lo : lo + CHUNK])
            sums = self.sums[lo + 1 : lo + 1 + len(part)]
            np.cumsum(part * low[: len(part)], out=sums)
            sums *= high[lo >> 16]
            sums += self.sums[lo]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * power(INVERSE, starts))


class Texts:
    """Some texts as flat UTF-8 bytes; nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words (runs without white space), and where each document's words begin."""
        solid = ~SPACE[self.data]
        size = len(solid)
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        full = np.flatnonzero(np.diff(self.offsets))
        before[self.offsets[full]] = False
        after[self.offsets[full + 1] - 1] = False
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of one class other than white space: starts, ends, classes, and where each document's runs begin."""
        kind = CLASS[self.data]
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[self.offsets] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        if len(starts):
            full = kind[starts] > 0
            starts, ends = starts[full], ends[full]
        return starts, ends, kind[starts], np.searchsorted(starts, self.offsets)

    def fold(self) -> Texts:
        """Lower case A-Z and Latin-1 letters."""
        data = LOWER[self.data]
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[second] += 0x20
        return Texts(data, self.offsets)

    def lower(self) -> Texts:
        """A-Z in lower case."""
        return Texts(LOWER[self.data], self.offsets)

    def hashes(self) -> SpanHash:
        return SpanHash(self.data, CODES)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Bytes of each document for which the flag holds."""
        if self.n == 1:
            return np.array([np.count_nonzero(flags)])
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines split at line feeds, and where each document's lines begin; one at least each."""
        breaks = np.flatnonzero(self.data == 10)
        doc = np.searchsorted(self.offsets, breaks, side="right") - 1
        order = np.argsort(np.concatenate([np.arange(self.n), doc]), kind="stable")
        starts = np.concatenate([self.offsets[:-1], breaks + 1])[order]
        order = np.argsort(np.concatenate([doc, np.arange(self.n)]), kind="stable")
        ends = np.concatenate([breaks, self.offsets[1:]])[order]
        per_doc = np.bincount(doc, minlength=self.n) + 1
        return starts, ends, np.concatenate([[0], np.cumsum(per_doc)])


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between successive bounds."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def texts_of(column: pa.Array) -> Texts:
    """The column's texts; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64))


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batch of about ``most`` bytes of text each, one row at least, so that work arrays stay small."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(texts_of(batch.column(column)).offsets))
    row = 0
    while row < batch.num_rows:
        base = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, base + most, side="right")))
        part = batch.slice(row, end - row)
        yield part, texts_of(part.column(column))
        row = end
