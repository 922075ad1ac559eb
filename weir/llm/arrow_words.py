"""Words and word hashes of Arrow text columns, computed on whole buffers with numpy.

Texts are cut at word boundaries in their UTF-8 form: all white space that counts is ASCII. A
word is hashed eight bytes at a time, each step a bijection of what came before, so words of up to eight
bytes never share a hash with another of their length. Hashes of runs of items are joined from
those of their halves. Nothing here is linear in the bytes or the items, so no pattern of repeats makes
two texts collide.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text worked on at once, unless one text is longer.
PIECE = 1 << 20
#: Longer words are hashed by the library, one by one.
LONG = 128
SEED_A, SEED_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ODD = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


T = TypeVar("T")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: What a process has loaded for its tasks, by name.
_loaded: dict[str, object] = {}


def loaded(name: str, make: Callable[[], T]) -> T:
    """make() once for each process, until a task begins that does not keep the name."""
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow that gives its memory back at the end: workers stay for later tasks, and what they hold counts all the while.

    What was loaded under other names than keep goes when it begins.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [name for name in _loaded if name != keep]:
            del _loaded[name]
        try:
            yield from work(batches)
        finally:
            release()

    return released


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about `size` bytes."""
    data, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of some texts: starts and ends in the bytes, first[i] the number of words before text i.

    With lines, the lines that hold a word in place of the words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lines: bool = False):
        space = data == 0x0A if lines else _SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        self.data, self.starts, self.ends = data, np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        if lines:
            filled = np.zeros(len(data) + 1, np.int64)
            np.cumsum(~_SPACE[data], out=filled[1:])
            some = filled[self.ends] > filled[self.starts]
            self.starts, self.ends = self.starts[some], self.ends[some]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = SEED_A) -> np.ndarray:
        size = self.ends - self.starts
        out = mixed(size.astype(np.uint64) * _ODD ^ np.uint64(seed))
        padded = np.append(self.data, np.zeros(8, np.uint8))
        live = np.flatnonzero(size <= LONG)
        for step in range(0, LONG, 8):
            live = live[size[live] > step]
            if not len(live):
                break
            bytes_ = padded[(self.starts[live] + step)[:, None] + np.arange(8)].view("<u8").ravel()
            over = np.maximum(step + 8 - size[live], 0).astype(np.uint64) * np.uint64(8)
            out[live] = mixed(out[live] ^ ((bytes_ << over) >> over)) + np.uint64(step + 1)
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.starts[k] : self.ends[k]].tobytes(), seed)
        return out

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words that start a run of `size` words inside one text."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self))
        return np.flatnonzero(room >= size)


class Runs:
    """Hashes of runs of successive items; shorter runs are kept for longer ones."""

    def __init__(self, hashes: np.ndarray):
        self.n, self.known = len(hashes), {1: hashes}

    def of(self, size: int) -> np.ndarray:
        """The hash of the `size` items from each place that has so many."""
        if size not in self.known:
            half = 1 << ((size - 1).bit_length() - 1)
            left, right = self.of(half), self.of(size - half)
            n = max(self.n - size + 1, 0)
            self.known[size] = mixed(left[:n] * _ODD + right[half : half + n])
        return self.known[size]


def set_hashes(items: np.ndarray, n: np.ndarray, seed: int = SEED_B) -> np.ndarray:
    """One hash for each of some sets, n the number of each one's items; zero for an empty set. The order of items does not matter."""
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        out[some] = mixed(np.add.reduceat(mixed(items ^ np.uint64(seed)), (np.cumsum(n) - n)[some]) + n[some].astype(np.uint64) * _ODD)
    return out


def least_run(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the first least value of g[i : i + width]."""
    at, span = np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        span += step
    return at
