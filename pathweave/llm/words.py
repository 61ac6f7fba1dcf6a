"""Whole texts as numpy arrays of word hashes, straight from Arrow's buffers.

A word is a run of bytes other than space and 0x09-0x0D.  Words are known by 64-bit hashes:
a polynomial over random byte values, mixed, so that two different words agree with a
probability near 2**-58.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is one piece of its own.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows in them."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return the memory that a batch needed to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, with its memory given back when a task's batches end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


#: glibc's numbers for mallopt: the free memory that is kept, the size from which an array is mapped.
_TRIM, _MMAP = -1, -3


def reusing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, with freed arrays' memory kept for the next ones until a task's batches end.

    Otherwise each array of some MB is mapped, faulted in page by page and unmapped again.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mallopt = getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)
        mallopt(_MMAP, 32 << 20)
        mallopt(_TRIM, 256 << 20)
        yield from run(batches)
        mallopt(_MMAP, 128 << 10)
        mallopt(_TRIM, 128 << 10)
        give_back()

    return kept


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about :data:`CHUNK_BYTES` of text; null texts become empty."""
    for batch in batches:
        i = batch.schema.get_field_index(text)
        if not batch.num_rows:
            continue
        column = pc.fill_null(batch.column(i), "")
        batch = batch.set_column(i, text, column)
        sizes = np.cumsum(np.diff(utf8(column)[1]))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end
        del batch, column
        give_back()


class Words:
    """The words of several texts: ``start``, ``end`` (bytes), ``hash``, and ``first``, where
    ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = (_LOWER if lower else _SAME)[data]
        self.offsets = offsets
        n = len(data)
        word = IS_WORD[data]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        up, down = _power(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, offsets)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words inside one text, and their first word's place."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            acc = mix(acc + np.uint64(k + 1)) + self.hash[k : k + n] if k else self.hash[:n].copy()
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        place = np.flatnonzero(text[:n] == text[size - 1 :])
        return mix(acc[place]), place
