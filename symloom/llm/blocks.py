"""Whole Arrow batches of text as numpy arrays: byte blocks, word spans and word hashes.

The functions here are small helpers inside Spark tasks.  A block is a run of consecutive rows whose
texts come to about ``BLOCK`` bytes, or one longer text; no text is ever cut.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _table(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


#: all bytes but space and \t to \r
VISIBLE = ~_table((0x20, 0x20), (0x09, 0x0D))
#: 0-9, a-z (texts are lower-cased first) and every byte of a non-ASCII character
ALNUM = _table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = column if not column.null_count else pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = filled.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def blocks(data: np.ndarray, ends: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row starts within the bytes with the end appended)."""
    row, rows = 0, len(ends) - 1
    while row < rows:
        after = int(np.searchsorted(ends, ends[row] + limit, "right")) - 1
        after = min(max(after, row + 1), rows)
        yield row, after, data[ends[row] : ends[after]], ends[row : after + 1] - ends[row]
        row = after


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (maximal run of bytes of ``kind`` in one row), and its row."""
    inside = kind[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(closes) + 1, np.searchsorted(starts[1:], first, "right")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + (BLOCK >> 1))
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=U64)
        if n > 4 * BLOCK:  # one very long text: not kept for the rest of the task
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def give_back() -> None:
    """Returns what this worker process holds but does not need: it lives on for later tasks and stages."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over Arrow batches that gives its memory back when it ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hashes`` takes hashes of any spans from them."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[after] - sums[first]) * down[first] + (after - first).astype(U64))


def windows(values: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` consecutive values of one row, and where the run begins."""
    if len(values) < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :])
    out = values[at]
    for step in range(1, size):
        out = mix(out * U64(3)) + values[at + step]
    return mix(out), at


def arrow_strings(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> list[str]:
    """The spans as strings."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8") for a, b in zip(first.tolist(), after.tolist(), strict=True)]
