"""Words and shingles as 64-bit hashes in numpy arrays, from the bytes of an Arrow column without a Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: The bytes between words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Masks that keep the first k bytes of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of ``data``, which goes on for eight bytes after the last."""
    size = ends - starts
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data.data, strides=(1,))
    # the size tells words from those with zero bytes behind them
    h = mixed((eight[starts] & _FIRST[np.minimum(size, 8)]) ^ mixed(size.astype(np.uint64)))
    at, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        h[at] = mixed((h[at] + np.uint64(0x9E3779B97F4A7C15)) ^ (eight[starts[at] + done] & _FIRST[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].data)
    return h


class Words:
    """The words of a column of texts (null: none): ``hashes``, and where each row's words begin (``first``, one more than rows).

    ``starts`` and ``ends`` are their places in ``data``, the bytes of all rows (lower-cased if asked for). ``strip`` takes ASCII
    punctuation from both ends of words that hold something else; ``separators`` marks the bytes that no word holds.
    """

    def __init__(self, column: pa.Array, lower: bool = False, strip: bool = False, separators: np.ndarray = _SPACE):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        raw = column.buffers()[2]
        data = np.zeros(high - low + 8, np.uint8)
        if high > low:
            here = np.frombuffer(raw, np.uint8, high - low, low)
            data[: high - low] = _LOWER[here] if lower else here
        self.data, self.offsets = data, offsets - low if len(column) else np.zeros(1, np.int64)
        self._split(high - low, separators)
        if strip:
            self._strip()
        self.hashes = hashed(self.data, self.starts, self.ends)

    def _split(self, n: int, separators: np.ndarray) -> None:
        space = separators[self.data[:n]]
        inside = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        after = np.r_[True, space[:-1]] if n else space
        before = np.r_[space[1:], True] if n else space
        after[inside] = True
        before[inside - 1] = True
        self.starts = np.flatnonzero(after & ~space)
        self.ends = np.flatnonzero(before & ~space) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def _strip(self) -> None:
        starts, ends = self.starts.copy(), self.ends.copy()
        at = np.flatnonzero(_PUNCTUATION[self.data[starts]])
        while len(at):
            starts[at] += 1
            at = at[(starts[at] < ends[at]) & _PUNCTUATION[self.data[starts[at]]]]
        some = starts < ends
        at = np.flatnonzero(some & _PUNCTUATION[self.data[ends - 1]])
        while len(at):
            ends[at] -= 1
            at = at[_PUNCTUATION[self.data[ends[at] - 1]]]
        self.starts, self.ends = np.where(some, starts, self.starts), np.where(some, ends, self.ends)

    def row(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]


def shingles(h: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of the n-word shingles of a sequence of word hashes; empty for fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(seed)
        out += h[k : len(h) - n + 1 + k]
    return mixed(out + np.uint64(n))
