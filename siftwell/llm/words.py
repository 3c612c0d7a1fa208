"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower-cases A-Z and takes ASCII punctuation for spaces.
PLAIN = np.where(np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)]), np.arange(256), np.where(np.isin(np.arange(256), range(65, 91)), np.arange(256) + 32, 32)).astype(np.uint8)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once; a longer text is taken alone.
CHUNK_BYTES = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_BYTE[_SPACE] = 0


def powers(n: int, base: np.uint64 = _MULTIPLIER) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words(NamedTuple):
    """starts and ends of the words within data; first[i]:first[i + 1] are the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = np.diff(self.starts, append=len(self.data))
        at = np.arange(self.starts[0], len(self.data), dtype=np.int64) - np.repeat(self.starts, sizes)
        values = _BYTE[self.data[self.starts[0] :]] * powers(int(sizes.max()))[at]
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mixed(np.add.reduceat(values, self.starts - self.starts[0]) + lengths * np.uint64(0xD6E8FEB86659FD93))


def rolling(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Fingerprints of every n consecutive entries; entry i is of hashes[i:i + n]."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    base = _MULTIPLIER + np.uint64(2 * salt)
    for k in range(n):  # n multiply-adds over the whole array
        out *= base
        out += hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)


def words_of(texts: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Words:
    """Words of a string array; null is an empty text. Bytes are mapped by a table first, where lower or table is set."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower or table is not None:
        data = (_LOWER if table is None else table)[data]
    if not len(data):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    space = _SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True  # a text's end ends a word
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1] | breaks[1:-1]
    stops = inside.copy()
    stops[:-1] &= space[1:] | breaks[1:-1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto
