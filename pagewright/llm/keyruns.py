"""Sorted runs of keys that tasks send to buckets, and what comes back in the same order.

A part of the documents sends each of its distinct 64-bit keys once: sorted, cut into
buckets by the upper bits and written in less than ``width`` bytes a key, one row a bucket.
What a bucket answers lies in the order of the keys it was sent, so no key travels back. A key
that every document has costs one entry a part, so no bucket is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

U = np.uint64
#: Keys a bucket is meant to get; further bits that keep two of n keys apart (a chance of 2**-SPARE a key).
BUCKET_KEYS, SPARE = 40_000, 23


def shape(keys: int) -> tuple[int, int]:
    """Bits of the bucket and bytes of the rest of a key, for so many keys in all."""
    bits = min(20, max(4, math.ceil(math.log2(max(keys, 1) / BUCKET_KEYS + 1))))
    return bits, min((64 - bits) // 8, max(2, math.ceil((math.log2(max(keys, 2)) + SPARE - bits) / 8)))


def cut(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The upper bits of keys that are kept."""
    return keys >> U(64 - bits - 8 * width)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values ``data[ends[k]:ends[k + 1]]`` (bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def runs(keys: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Buckets, where each begins in the sorted cut ``keys`` (and the end), and each one's keys in two columns.

    ``low`` has the lower ``width - 1`` bytes of each key; ``high`` a bit string in which key k of a run sets
    bit k + (its upper byte), as that byte only grows along a run (Elias-Fano code).
    """
    bucket = (keys >> U(8 * width)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(begin, len(keys))
    size = np.diff(ends)
    raw = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
    base = np.concatenate([[0], np.cumsum((size + 255) // 8 + 1)])
    bit = np.zeros(8 * int(base[-1]), np.uint8)
    bit[np.repeat(8 * base[:-1] - begin, size) + np.arange(len(keys)) + raw[:, 8 - width]] = 1
    return bucket[begin], ends, binaries(np.packbits(bit), base), binaries(raw[:, 9 - width :].ravel(), ends * (width - 1))


def keys_of(high: pa.Array, low: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (without their bucket) of some runs, one after the other, and where each run begins, with the end."""
    ends, data = spans(low)
    ends = ends // (width - 1)
    base, packed = spans(high)
    raw = np.zeros((int(ends[-1]), 8), np.uint8)
    raw[:, 9 - width :] = data.reshape(-1, width - 1)
    raw[:, 8 - width] = np.flatnonzero(np.unpackbits(packed)) - np.arange(len(raw)) - np.repeat(8 * base[:-1] - ends[:-1], np.diff(ends))
    return raw.view(">u8").ravel().astype(U), ends


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def small(counts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts of runs as one byte each, and those over 254 as int64 in order of their place."""
    large = counts > 254
    before = np.concatenate([[0], np.cumsum(large)])
    return binaries(np.where(large, 255, counts).astype(np.uint8), ends), binaries(counts[large].astype(np.int64).view(np.uint8), 8 * before[ends])


def counts_of(byte: pa.Array, large: pa.Array) -> np.ndarray:
    """The counts of all runs, one after the other."""
    out = spans(byte)[1].astype(np.int64)
    out[out == 255] = np.frombuffer(spans(large)[1].tobytes(), np.int64)
    return out
