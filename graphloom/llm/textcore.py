"""Vectorised text primitives over Arrow batches (no per-row Python).

Words are maximal runs of ASCII letters and digits and of bytes >= 0x80 in the
lower-cased UTF-8 text. Nulls read as empty text. Work goes on in slices of
about ``SLICE_BYTES`` whole rows, so memory follows the longest row, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64 finaliser, elementwise on uint64."""
    h = h + np.uint64((seed * _PRIME + 0x1234567) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        inverse = np.uint64(pow(_PRIME, -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (np.uint64(_PRIME), inverse)]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for many spans, from one prefix sum."""
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def text_bytes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, each followed by a newline, and the rows' offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    glue = pa.scalar("\n", pa.large_string())
    column = pc.binary_join_element_wise(pc.utf8_lower(column) if lower else column, pa.scalar("", pa.large_string()), glue)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return memory that nothing uses to the system: a worker process stays for the next task, which may be another operator's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def row_slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about limit bytes of text."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


@dataclass
class Words:
    data: np.ndarray
    rows: np.ndarray  # offsets of the rows in data
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per row, its first word; one more at the end


def words(column: pa.Array) -> Words:
    data, rows = text_bytes(column, lower=True)
    inside = _IS_WORD[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate([[0], change])
    start, end = change[0::2], change[1::2]
    return Words(data, rows, start, end, span_hashes(data, start, end), np.searchsorted(start, rows))


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nonempty segments and their starts."""
    kept = np.flatnonzero(first[1:] > first[:-1])
    return kept, first[:-1][kept]


_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8))
_RUN = 255


def simhash(features: np.ndarray, starts: np.ndarray, words64: int) -> np.ndarray:
    """SimHash of each segment of feature hashes: (segments, words64) uint64.

    Bit counts add up in byte lanes, eight bits of the hash at a time, over runs
    of at most 255 features; runs are then summed into exact counts. A bit is set
    where more than half of the features set it.
    """
    total, n = len(features), len(starts)
    if not n:
        return np.zeros((0, words64), dtype=np.uint64)
    ends = np.append(starts[1:], total)
    runs_of = -(-(ends - starts) // _RUN)
    owner = np.repeat(np.arange(n), runs_of)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of)
    runs = starts[owner] + within * _RUN
    first_run = np.cumsum(runs_of) - runs_of
    out = np.zeros((n, words64), dtype=np.uint64)
    half = (ends - starts)[:, None]
    for j in range(words64):
        octets = mix(features, j + 1).view(np.uint8).reshape(total, 8)
        bits = np.zeros((n, 64), dtype=bool)
        for k in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, k]], runs).view(np.uint8).reshape(-1, 8)
            counts = lanes if len(runs) == n else np.add.reduceat(lanes.astype(np.int32), first_run, axis=0)
            bits[:, 8 * k : 8 * k + 8] = counts.astype(np.int32) * 2 > half
        out[:, j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def distinct_in_rows(word: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each row: hashes (48 bits spread again), and the rows' first indices."""
    row = np.repeat(np.arange(len(word.first) - 1, dtype=np.uint64), np.diff(word.first))
    key = np.unique((row << np.uint64(40)) | (word.hash >> np.uint64(24)))
    first = np.searchsorted(key, np.arange(len(word.first), dtype=np.uint64) << np.uint64(40))
    return mix(key & np.uint64((1 << 40) - 1), 99), first
