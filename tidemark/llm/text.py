"""Words and word hashes of whole Arrow batches, without a Python loop per word.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``; lower case means A-Z only.
Null texts are empty. Arrays are cut into stretches of whole documents, so that
the working memory follows ``STRETCH`` and not the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STRETCH = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_powers: list[np.ndarray] = []
_memos: dict[str, dict] = {}


def memo(owner: str) -> dict:
    """What one operator keeps in a Python worker from task to task.

    Workers serve all stages of an application, so taking a memo, or beginning
    another operator's work, gives back what the others have kept.
    """
    others = [name for name in _memos if name != owner]
    for name in others:
        _memos.pop(name).clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:  # glibc keeps what was freed until it is told
            trim(0)
    return _memos.setdefault(owner, {})


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(_SEGMENT + 1, base, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or pa.types.is_null(column.type):
        column = pc.fill_null(column.cast(pa.string()), "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def stretches(offsets: np.ndarray, limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


LETTER_RUNS = np.zeros(256, np.uint8)
LETTER_RUNS[97:123] = LETTER_RUNS[65:91] = LETTER_RUNS[128:] = 1
#: Small letters and bytes beyond ASCII, capitals, digits, other signs.
KIND_RUNS = np.full(256, 4, np.uint8)
KIND_RUNS[_SPACE] = 0
KIND_RUNS[97:123] = KIND_RUNS[128:] = 1
KIND_RUNS[65:91] = 2
KIND_RUNS[48:58] = 3


def runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the runs of bytes of one kind (not 0), which end with their document."""
    kind = kinds[data]
    change = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    at = np.flatnonzero(kind[edges[:-1]])
    return edges[at], edges[at + 1], np.searchsorted(edges[at], offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, bounds): words of document d are bounds[d]:bounds[d+1]."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    inside[-1] = False
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = inside[cut]
    last = inside[:-1].copy()
    last[:-1] &= ~inside[1:-1]
    edge = offsets[1:][np.diff(offsets) > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, from prefix sums of a polynomial over the bytes."""
    up, down = powers()
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(ends, base + _SEGMENT, "right"))
        if hi <= lo:  # one span beyond a segment
            out[lo] = np.uint64(zlib.crc32(data[starts[lo] : ends[lo]]) | zlib.adler32(data[starts[lo] : ends[lo]]) << 32)
            lo += 1
            continue
        stop = int(ends[hi - 1])
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:stop]] * up[: stop - base], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * down[s]
        lo = hi
    return mix(out)


def hash_one(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def crc_of_ids(column: pa.Array) -> np.ndarray:
    """crc32 of each id as text, and 0 for a null."""
    return np.array([0 if x is None else zlib.crc32(str(x).encode()) for x in column.to_pylist()], np.int64)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [columns[f.name]]], schema=schema)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
