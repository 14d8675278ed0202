"""Words, word grams and their 64-bit hashes over Arrow string columns, in NumPy.

A batch is worked through in slices of about SLICE bytes, so that memory does not follow the batch; one longer text
makes a slice of its own. Hashes depend on the content alone, so equal words hash alike in every task. A word is hashed
eight bytes after eight, each through a full mixing step, so words of up to eight bytes never collide with others of
their length; a word beyond LONG_WORD bytes goes by its BLAKE2 digest.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
LONG_WORD = 64
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GRAM = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)], np.uint64)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

#: Which bytes belong to words: everything but white space; or letters a-z, digits and all of non-ASCII, after lower-casing.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

def release() -> None:
    """Give freed memory back to the machine: workers are used again, and what one stage kept would count for the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows within these bytes); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the offsets of the rows among the words. ``cut``: positions inside words at which another word begins."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    on = table[data]
    full = offsets[:-1] < offsets[1:]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    first[offsets[:-1][full]] = on[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = on[offsets[1:][full] - 1]
    if cut is not None:
        first[cut] = True
        last[cut - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Bytes:
    """The bytes of a slice, A-Z lower-cased if ``lower``, to be read eight at a time."""

    def __init__(self, data: np.ndarray, lower: bool = True) -> None:
        self.raw = np.zeros(len(data) + 8, np.uint8)
        self.raw[: len(data)] = LOWERED[data] if lower else data
        self.words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=self.raw, strides=(1,))

    def eight(self, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The first eight bytes of each span as a number; those past its end, at ``length``, are zero."""
        return self.words[starts] & _MASKS[np.clip(length, 0, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each span; with another ``salt``, an independent one."""
        length = ends - starts
        seed = length.astype(np.uint64) * np.uint64(_BASE) + np.uint64(salt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        out = mix(self.eight(starts, length) ^ mix(seed))
        at, done = np.flatnonzero(length > 8), 8
        while len(at) and done < LONG_WORD:
            out[at] = mix(out[at] * _STEP + self.eight(starts[at] + done, length[at] - done))
            done += 8
            at = at[length[at] > done]
        for k in at.tolist():
            digest = hashlib.blake2b(self.raw[starts[k] : ends[k]], digest_size=8, salt=salt.to_bytes(1, "little")).digest()
            out[k] = int.from_bytes(digest, "little")
        return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, A-Z lower-cased if ``lower``, and the offsets of the rows among the words."""
    starts, ends, rows = spans(data, offsets, table)
    return starts, ends, Bytes(data, lower).hashes(starts, ends), rows


def grams(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; runs that cross rows are to be left out by the caller."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (k * _BASE) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(k):
        total += hashed[j : j + n] * _GRAM[j]
    return mix(total)


def shingle_sets(hashed: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word runs of each row; of the whole row where it has fewer words, none without words."""
    found, runs = [], grams(hashed, k)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            one = np.sort(runs[a : b - k + 1])
            found.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        else:
            found.append(grams(hashed[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return found


def wide_shingle_sets(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, k: int) -> list[np.ndarray]:
    """The same with 128 bits for each run: (runs, 2) hashes by independent salts, in order of the first and then the second."""
    starts, ends, rows = spans(data, offsets, table)
    text, found = Bytes(data), []
    one, two = text.hashes(starts, ends), text.hashes(starts, ends, 1)
    first, second = grams(one, k), grams(two, k)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            x, y = first[a : b - k + 1], second[a : b - k + 1]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            found.append(np.stack([x[new], y[new]], 1))
        else:
            found.append(np.stack([grams(h[a:b], b - a) for h in (one, two)], 1) if b > a else np.zeros((0, 2), np.uint64))
    return found


def shared_count(x: np.ndarray, y: np.ndarray) -> int:
    """How many runs two wide sets have in common."""
    at = np.minimum(np.searchsorted(y[:, 0], x[:, 0]), len(y) - 1)
    if (x[1:, 0] == x[:-1, 0]).any() or (y[1:, 0] == y[:-1, 0]).any():  # first halves that collide
        return len({tuple(r) for r in x.tolist()} & {tuple(r) for r in y.tolist()})
    return int((y[at] == x).all(1).sum())
