"""Byte-level text helpers on numpy, shared by the operators of this subpackage.

All of them work on a slice of documents held in one byte buffer with offsets, so a
batch costs a fixed number of array passes whatever its number of documents is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are held as arrays at once; one longer document makes a longer slice.
SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


@functools.cache
def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size - 1, base, dtype=np.uint64))))
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit moves every output bit."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def as_binary(column) -> pa.Array:
    """A text column of a batch as UTF-8 bytes; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return pc.fill_null(column, b"") if column.null_count else column


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of consecutive slices of about limit bytes; a row is never cut."""
    arr = as_binary(column)
    n = len(arr)
    if not n:
        return
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, offs[row : end + 1] - offs[row], data[offs[row] : offs[end]]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words [^\\x20\\x09-\\x0D]+."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_codes(seed)[data] * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(BASE_INV, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every document, and the number of its shingles as offsets.

    A document of fewer words has the whole sequence as its one shingle; one without words has none.
    Letters A-Z are folded to lower case first.
    """
    data = LOWER[data]
    s, e, doc = word_spans(data, offs)
    h = span_hashes(data, s, e)
    docs = len(offs) - 1
    n = len(h)
    per = np.bincount(doc, minlength=docs) if n else np.zeros(docs, dtype=np.int64)
    counts = np.where(per >= size, per - size + 1, (per > 0).astype(np.int64))
    out_offs = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(out_offs[-1], dtype=np.uint64)
    if not n:
        return out, out_offs
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc[: n - k] = mix(acc[: n - k] * U64(0xA0761D6478BD642F) + h[k:])
    first = np.concatenate(([0], np.cumsum(per)))
    within = np.arange(n) - first[doc]
    full = (within <= per[doc] - size) & (per[doc] >= size)
    out[out_offs[doc[full]] + within[full]] = acc[full]
    for d in np.flatnonzero((per > 0) & (per < size)):
        x = U64(per[d])
        with np.errstate(over="ignore"):
            for v in h[first[d] : first[d + 1]]:
                x = mix(np.array([x * U64(0xE7037ED1A0B428DB) + v], dtype=np.uint64))[0]
        out[out_offs[d]] = x
    return out, out_offs
