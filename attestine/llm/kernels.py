"""Vectorised byte and word kernels for Arrow batches.

Everything works on the UTF-8 buffer of an Arrow string column, several documents at a time, without a Python
loop over words. The module is pickled by value, so that executors need no copy of the package.
"""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

CHUNK_BYTES = 1 << 18
START = 10  # what stands before a text's first byte: line ends
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)


def worker_cache() -> types.ModuleType:
    """A namespace that outlives a task in a reused Python worker."""
    return sys.modules.setdefault("_attestine_worker_cache", types.ModuleType("_attestine_worker_cache"))


def trim() -> None:
    """Give freed memory back to the system: a reused worker else keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    cache = worker_cache()
    if not hasattr(cache, "trim"):
        cache.trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if cache.trim:
        cache.trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    shifted = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
        x ^= np.right_shift(x, np.uint64(shift), out=shifted)
        if factor:
            x *= np.uint64(factor)
    return x


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base**i, base**-i for i < n and a random word for each byte value."""
    cache = worker_cache()
    name = f"powers{which}"
    have = getattr(cache, name, None)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1], mix(np.arange(256, dtype=np.uint64) + np.uint64(_SEEDS[which])))
        setattr(cache, name, have)
    return have


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """c with c[j] - c[i] = hash of data[i:j] times base**i; one longer than data."""
    power, _, table = _powers(len(data) + 1, which)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each pair, the same wherever these bytes stand."""
    _, inverse, _ = _powers(len(prefix), which)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hashes(prefix: np.ndarray, gram: int, which: int = 0) -> np.ndarray:
    """span_hash of the `gram` bytes at each place."""
    _, inverse, _ = _powers(len(prefix), which)
    return mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(prefix) - gram] + np.uint64(gram))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES):
    """(first row, row after the last, bytes, offsets from 0) for groups of whole documents of about `most` bytes."""
    data, offs = utf8(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last
    trim()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes other than space and 0x09-0x0D, and the first word of each document."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = offs[1:-1][offs[1:-1] < len(data)] if len(offs) > 2 else np.zeros(0, np.int64)
    begins = inside & ~before[:-1]
    begins[edge] = inside[edge]
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    ends = inside & ~after[1:]
    ends[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word after lower-casing A-Z, and the first word of each document."""
    data = lower_ascii(data)
    start, end, first = words(data, offs)
    return span_hash(prefix_hash(data), start, end), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words, and the first of each document; a shorter document is one run of all its words."""
    count = np.diff(first)
    per = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(per, out=begin[1:])
    total = int(begin[-1])
    doc = np.repeat(np.arange(len(per)), per)
    at = first[doc] + (np.arange(total) - begin[doc])
    have = np.minimum(count[doc], width)
    out = mix(have.astype(np.uint64) + np.uint64(0x243F6A8885A308D3))
    for j in range(width):
        use = j < have
        term = hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(total, np.uint64)
        out = np.where(use, mix(out * np.uint64(0x100000001B3) + term), out)
    return out, begin


def byte_grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Four bytes ending at each position as a 32-bit number; predecessors of a text's first byte are line ends."""
    back = [data]
    for j in (1, 2, 3):
        prev = np.empty_like(data)
        prev[j:] = data[:-j] if len(data) > j else data[:0]
        prev[:j] = START
        for k in range(j):  # positions closer than j to a text's start
            at = offs[:-1] + k
            prev[at[at < np.minimum(offs[1:], len(data))]] = START
        back.append(prev)
    return (back[3].astype(np.uint32) << 24) | (back[2].astype(np.uint32) << 16) | (back[1].astype(np.uint32) << 8) | back[0]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
