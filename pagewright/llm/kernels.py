"""Vectorised text primitives over Arrow string buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
A word's 64-bit hash is a polynomial over its bytes modulo 2**64, taken from
prefix sums of the whole buffer, then finalised; equal words always get equal
hashes, and among n different words a collision has a chance of about n*n/2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):
    _libc.mallopt(-3, 1 << 20)  # blocks of 1 MB and more go back to the system when they are freed
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, U), np.ones(1, U)]
#: Bytes handled at a time; a longer document is cut between words.
SLICE = 1 << 19


def release() -> None:
    """Give unused memory back, as workers are kept and several share an executor."""
    if len(_powers[0]) > 1 << 20:
        _powers[:] = [np.ones(1, U), np.ones(1, U)]
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def keep_blocks() -> None:
    """For workers of operators that make many large arrays: freed blocks are used again until ``release``, instead of being mapped and cleared anew each time."""
    if hasattr(_libc, "mallopt"):
        _libc.mallopt(-3, 1 << 30)
        _libc.mallopt(-1, 1 << 30)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            full = np.full(size, b, U)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``values[s:e]`` (uint64 values)."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def order_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys of so many bits. Sorts the upper bits with the place in the lower ones, which is much faster than argsort."""
    n = len(keys)
    place = max(n - 1, 1).bit_length()
    spare = max(0, bits + place - 64)
    packed = (keys >> U(spare)) << U(place) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & U((1 << place) - 1)).astype(np.int64)
    if spare:  # keys that agree in the upper bits, if any
        found = keys[order]
        if (found[1:] < found[:-1]).any():
            order = order[np.argsort(found, kind="stable")]
    return order


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of at most 4096 documents with at most ``limit`` bytes, or of a single one."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n, a + 4096)
        yield a, b
        a = b
    release()


def words(data: np.ndarray, offs: np.ndarray, step: int = 4 * SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends (positions in ``data``) and first word of each document (one more at the end); ``step`` bytes at a time."""
    lo, hi = int(offs[0]), int(offs[-1])
    parts, at = [], lo
    while at < hi:
        end = min(hi, at + step)
        while end < hi:  # cut before white space
            found = np.flatnonzero(_SPACE[data[max(at, end - 65536) : end]])
            if len(found) and max(at, end - 65536) + found[-1] > at:
                end = max(at, end - 65536) + int(found[-1])
                break
            end = min(hi, end + SLICE)
        piece = data[at:end]
        gap = np.ones(len(piece) + 2, bool)
        gap[1:-1] = _SPACE[piece]
        cuts = np.zeros(len(piece) + 1, bool)
        inner = offs[(offs > at) & (offs < end)] - at
        cuts[inner] = True
        start = np.flatnonzero(~gap[1:-1] & (gap[:-2] | cuts[:-1])) if len(piece) else np.zeros(0, np.int64)
        stop = np.flatnonzero(~gap[:-1] & (gap[1:] | cuts)[: len(gap) - 1])
        parts.append((spans_hash(_BYTE[piece], start, stop), start + at, stop + at))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offs), np.int64)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offs)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each position, and whether they lie in one document."""
    n = len(hashes)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    out = np.zeros(n, U)
    for k in range(width):
        out[: max(n - k, 0)] += hashes[k:] * U(0xD6E8FEB86659FD93 + 2 * k * 0x1234567)
        out = (out << U(9)) | (out >> U(55))
    return mixed(out), room >= width


def crc_of_id(column: str) -> str:
    """SQL of the remainder base: crc32 of the id as text."""
    return f"crc32(cast({column} as string))"
