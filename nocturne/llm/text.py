"""Vectorised work on batches of UTF-8 texts: slices of bounded size, words, and hashes and identity of byte ranges.

A range of up to seven bytes is its own hash, packed with its length. A longer one is hashed with a polynomial over the
mixed values of the eight bytes at each of its places: with ``P`` the prefix sums modulo 2**64, the range [s, e) has the
value (P[e-7] - P[s]) * B**-s, mixed with its length. Places stand for eight bytes each, through a non-linear map, so the
words on which plain polynomials modulo 2**64 fail (Thue-Morse words) are told apart. Two seeds give 128 bits. Where
identity decides a result and the bytes are at hand, ``distinct`` compares them.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64
SPREAD = (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
STEP = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
INSIDE = ~SPACE
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(8)], U)


@functools.cache
def powers(base: int, step: int = 1) -> np.ndarray:
    """STEP powers of base ** step modulo 2**64; two such tables give any power, so none grows with the texts."""
    out = np.full(STEP, pow(base, step, 1 << 64), U)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Ranges:
    """Hashes of ranges of one array of bytes; hashes of different seeds are independent."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n, self.seed = len(data), seed
        held = np.zeros(n + 8, np.uint8)
        held[:n] = data
        self.eight = np.ndarray((n + 1,), "<u8", held, strides=(1,)).copy()
        x = self.eight[: max(n - 7, 0)] * U(SPREAD[seed])
        x ^= x >> U(31)
        low, high = powers(BASES[seed]), powers(BASES[seed], STEP)
        for i in range(0, len(x), STEP):
            x[i : i + STEP] *= low[: len(x) - i] * high[i // STEP]
        self.prefix = np.zeros(len(x) + 1, U)
        np.cumsum(x, out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        packed = self.eight[start]
        long = size > 7
        x = (packed & _FIRST[np.where(long, 0, size)]) | (size.astype(U) << U(56))
        if long.any():
            s, e = (start, end) if long.all() else (start[long], end[long])
            inverse = pow(BASES[self.seed], -1, 1 << 64)
            y = (self.prefix[e - 7] - self.prefix[s]) * powers(inverse)[s % STEP] * powers(inverse, STEP)[s // STEP]
            x[long] = mix(y + (e - s).astype(U) * U(0xA24BAED4963EE407))
        return mix(x * U(SPREAD[1]) if self.seed else x)


def same_bytes(a: np.ndarray, start_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are a[start_a : start_a + size] and b[start_b : start_b + size] equal? In pieces of 4 MB."""
    out = np.ones(len(size), bool)
    upto = np.cumsum(size)
    lo = 0
    while lo < len(size):
        base = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, base + (4 << 20), "right")))
        n = size[lo:hi]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = a[np.repeat(start_a[lo:hi], n) + place] != b[np.repeat(start_b[lo:hi], n) + place]
        if differ.any():
            out[lo + np.unique(np.repeat(np.arange(hi - lo), n)[differ])] = False
        lo = hi
    return out


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value is first, in the order of the values, and which of them each value is. As np.unique has
    it, but sorts the distinct values alone."""
    found = pa.array(h).dictionary_encode()
    code = found.indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))  # codes count up as values are met
    order = np.argsort(found.dictionary.to_numpy())
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return first[order], rank[code]


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct byte strings among the ranges: one range of each, in the order of their hashes h, and for every
    range which it is. Ranges of one hash are compared, so different strings of equal hash are told apart."""
    sample, back = numbered(h)
    other = sample[back]
    sizes = end - start
    check = np.flatnonzero((np.maximum(sizes, sizes[other]) > 7) & (other != np.arange(len(h))))
    wrong = sizes[check] != sizes[other[check]]
    wrong |= ~same_bytes(data, start[check], data, start[other[check]], np.where(wrong, 0, sizes[check]))
    if wrong.any():
        met: dict[bytes, int] = {}
        more = []
        for i in check[wrong].tolist():
            body = data[start[i] : end[i]].tobytes()
            if body not in met:
                met[body] = len(sample) + len(more)
                more.append(i)
            back[i] = met[body]
        sample = np.concatenate([sample, np.array(more, sample.dtype)])
    return sample, back


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges one after another, and where each begins (and the last ends)."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and where each row begins; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers stay for later tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def sized(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        ends = utf8(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``, in order."""
    inside = INSIDE.take(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lowered, then its row, start and end."""
    starts, ends, row = words(data, offsets)
    return Ranges(LOWER[data], seed)(starts, ends), row, starts, ends


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words of one text; of all words as one run if there are fewer; none for none."""
    if not len(h):
        return h
    n = min(k, len(h))
    out = np.zeros(len(h) - n + 1, U)
    for i in range(n):
        out = out * U(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
    return mix(out + U(n))


def binaries(body: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """The byte strings body[bounds[i] : bounds[i + 1]] as an Arrow column."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body)])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive groups of values as an Arrow list column."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of sorted rows, tables that hold whole groups of equal keys, and where each group begins (and the last ends)."""
    held: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows + 1, bool)
        new[[0, -1]] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:-1] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0] is not batch and all(held[0].column(k)[0] == batch.column(k)[-1] for k in keys):
            continue  # still one group
        t = pa.Table.from_batches(held)
        at = cuts(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
        held = t.slice(at[-2]).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, cuts(t)
