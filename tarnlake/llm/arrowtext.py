"""Texts of Arrow batches as flat byte arrays, and words in them, without a Python loop over rows."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is worked on alone.
PIECE_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more offset at the end). Null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    edges = np.frombuffer(offsets, kind, n + 1, at * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    if column.null_count:
        sizes, gone = np.diff(edges), column.is_null().to_numpy(zero_copy_only=False)
        if sizes[gone].any():
            whole = whole[np.repeat(~gone, sizes)]
            edges = np.concatenate([[0], np.cumsum(np.where(gone, 0, sizes))])
    return whole, edges


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `limit` bytes of text each, or a single row."""
    if not batch.num_rows:
        return
    _, edges = flat(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def flat_pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """flat() of a list of texts, piece by piece: what is worked out for one piece bounds the memory, not the list."""
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    for piece in pieces(batch, "text"):
        yield flat(piece.column(0))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released() -> None:
    """Gives memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Batches) -> Batches:
    """`run`, after which a worker gives freed memory back: workers live on from task to task, beside each other."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return tidied


def runs(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of True begin and end (exclusive), cut at row edges, and the number of runs in each row."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(edges) - 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = edges[:-1][edges[:-1] < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = edges[1:][edges[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, edges))


def _grown(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        for base, name in ((_BASE, "_POWERS"), (pow(_BASE, -1, 2**64), "_INVERSES")):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: each bit of the result depends on each bit of `h`."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """64-bit hashes of any stretch of a byte array, each in constant time, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        _grown(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[data] * _POWERS[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))
