"""Word boundaries and 64-bit hashes of whole Arrow text columns, as numpy arrays.

A word is a run of bytes other than the space and the five ASCII controls 0x09 to 0x0D. UTF-8 uses
none of those bytes inside a longer character, so the bytes can be taken as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first n bytes of a little-endian 64-bit word.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
LONGEST = 512


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def tidily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and then Arrow's unused memory back to the system: a worker goes on to other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def text_chunks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``most`` bytes: the first row, the bytes, and the
    rows' offsets in them. A longer row is a chunk of its own; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of a chunk."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands. Eight bytes at a time go
    through ``mix``, which isn't linear: no structure of the bytes makes hashes meet, as it does with polynomials
    modulo 2**64. Spans above LONGEST bytes are digested by BLAKE2b."""
    sizes = (ends - starts).astype(np.int64)
    out = mix((sizes.astype(U64) + U64(seed)) * U64(0x9E3779B97F4A7C15) + U64(1))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    todo, at = np.flatnonzero((sizes > 0) & (sizes <= LONGEST)), 0
    while len(todo):
        block = eight[starts[todo] + at] & FIRST_BYTES[np.minimum(sizes[todo] - at, 8)]
        out[todo] = mix(out[todo] ^ block)
        at += 8
        todo = todo[sizes[todo] > at]
    for k in np.flatnonzero(sizes > LONGEST).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    weights = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    total = np.zeros(n, U64)
    for k in range(width):
        total += values[k : k + n] * weights[k]
    return mix(total + U64(width))
