"""Text as numpy arrays: byte buffers of Arrow batches, word bounds, rolling hashes, sliding minima."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

U64 = np.uint64
NONE = np.uint64(2**64 - 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Each value scrambled, one to one, so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64)) | U64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any stretch of a sequence of codes, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up[:n], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: n + 1 - k])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each value starts and ends; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:]
    if column.null_count:
        ends = np.where(column.is_valid().to_numpy(zero_copy_only=False), ends, starts)
    return data, starts, ends


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows [a, b) of at most `most` in sum, or of one row that is larger."""
    total, a = np.concatenate([[0], np.cumsum(sizes)]), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b
    release()


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library: it does so by itself, or can't
        return lambda keep: None


def release() -> None:
    """Gives freed memory back to the system; Python workers live on between tasks, and share an executor's limit."""
    _trim()(0)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes in one buffer without gaps, and the n + 1 bounds in it."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if len(starts) and ends[-1] - starts[0] == bounds[-1] and (starts[1:] == ends[:-1]).all():
        return data[starts[0] : ends[-1]], bounds
    return np.concatenate([data[a:b] for a, b in zip(starts, ends, strict=True)] or [np.zeros(0, np.uint8)]), bounds


def code_points(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of texts in one buffer; then buffer and bounds, with a replacement for what isn't UTF-8."""
    try:
        text = buf.tobytes().decode()
    except UnicodeDecodeError:
        parts = [buf[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(bounds, bounds[1:], strict=False)]
        buf, bounds = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        text = buf.tobytes().decode()
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), buf, bounds


def words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and the n + 1 bounds of the documents in the list of words."""
    full = bounds[1:] > bounds[:-1]
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = bounds[:-1][full]
    first[at] = inside[at]
    at = bounds[1:][full] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def sliding(x: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """The minimum (or maximum) of each w consecutive values: len(x) - w + 1 of them."""
    f = np.minimum if least else np.maximum
    out, have = x, 1
    while have * 2 <= w:
        out = f(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return f(out[:-rest], out[rest:]) if rest else out


#: Bits of a place in a buffer (16 GB); those above hold the start of a hash.
PLACE = (1 << 34) - 1


def winnow(h: np.ndarray, w: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of w values each that begin at `starts` (ascending): the place of the last least value, without
    repetition, and the first and the last of the windows that have it there."""
    if not len(starts):
        return starts, starts, starts
    key = (h & ~U64(PLACE)) | (U64(PLACE) - np.arange(len(h), dtype=np.uint64))
    at = PLACE - (sliding(key, w)[starts] & U64(PLACE)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return at[new], starts[new], starts[last]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = sizes > 0
    starts, sizes = starts[keep], sizes[keep]
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out[heads] = starts
    out[heads[1:]] -= starts[:-1] + sizes[:-1] - 1
    return np.cumsum(out)


class WordCache:
    """Token ids of words by the words' codes, in arrays: a large sorted level, and a small one for the latest words.

    encode: the ids of each of some words. Past `most` words it starts anew.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 800_000, small: int = 1 << 18):
        self.encode, self.most, self.small = encode, most, small
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.levels = np.zeros(0, np.uint32), [none, none]

    def of(self, codes: np.ndarray, word: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in the ids (the last value) each word's begin, and how many they are; codes ascend; word(i): the i-th."""
        if len(self.levels[0][0]) > self.most:
            self._clear()
        start, size = np.full(len(codes), -1), np.zeros(len(codes), np.int64)
        for known, starts, sizes in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[at] == codes
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
        new = np.flatnonzero(start < 0)
        if len(new):
            found = self.encode([word(i) for i in new.tolist()])
            size[new] = np.fromiter(map(len, found), np.int64, len(found))
            start[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size[new].sum()))])
            self.levels[1] = self._merged(self.levels[1], (codes[new], start[new], size[new]))
            if len(self.levels[1][0]) > self.small:
                self.levels = [self._merged(*self.levels), tuple(x[:0] for x in self.levels[1])]
        return start, size, self.ids

    @staticmethod
    def _merged(a, b):
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))
