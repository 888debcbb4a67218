"""Words of texts as arrays: places, counts a text and hashes, with no Python object a word.

A word is a run of bytes that are no ASCII white space (space, tab to carriage return).  Its hash is
the polynomial sum of random numbers drawn for its bytes, read off running sums of the whole buffer,
then mixed with its length; words above ``PIECE`` bytes are hashed alone.  A pair of hashes (128
bits) stands for the word where counts must be exact.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text whose running sums are held at a time, and the longest word that goes through them.
PIECE = 1 << 16
#: Bytes of text that ``slices`` puts together.
SLICE = 2 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def slices(column: pa.Array, size: int = SLICE):
    """(first, last) rows of consecutive parts of a string column, each of about ``size`` bytes or one text."""
    _, at = flat(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[int(at[0]) : int(at[-1])], at.astype(np.int64) - int(at[0])


def places(raw: np.ndarray, at: np.ndarray, cut: np.ndarray | None = None, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words, and the number of the first word of each text (one more at the end).
    Where ``cut`` is true, which is inside words alone, another word starts; ``space`` are the bytes of no word."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~space[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    if cut is not None:
        first |= cut
        last[:-1] |= cut[1:]
    edge = at[:-1][at[:-1] < len(raw)]
    first[edge] |= solid[edge]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] |= solid[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


class Hash:
    """One hash function over words; with ``fold`` A-Z count as a-z."""

    def __init__(self, seed: int, fold: bool = True):
        rng = np.random.default_rng([20250101, seed])
        self.seed, self.fold = seed, fold
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            self.table[65:91] = self.table[97:123]
        base = int(rng.integers(1, 1 << 60)) * 8 + 3
        inverse = pow(base, -1, 1 << 64)
        self.power, self.inverse = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, b % (1 << 64), np.uint64))]) for b in (base, inverse))

    def prefix(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``raw[starts:ends]``, places in ascending order that do not overlap."""
        return self.sealed(self.sums(raw, starts, ends), ends - starts)

    @staticmethod
    def sealed(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of words from their sums and sizes."""
        return mix(sums ^ (size.astype(np.uint64) * _M1))

    def joined(self, left: np.ndarray, size: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sums of words that are put together, the left ones of ``size`` bytes."""
        return left + right * self.power[size]

    def sums(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The polynomial sums of words; of words above PIECE bytes another hash."""
        out, n, i = np.empty(len(starts), np.uint64), len(starts), 0
        while i < n:
            lo = int(starts[i])
            j = int(np.searchsorted(ends, lo + PIECE, side="right"))
            if j <= i:
                w = raw[lo : int(ends[i])].tobytes()
                out[i] = xxhash.xxh3_64_intdigest(w.lower() if self.fold else w, self.seed)
                i += 1
                continue
            s, e = starts[i:j] - lo, ends[i:j] - lo
            x = self.table[raw[lo : int(ends[j - 1])]]
            x *= self.power[: len(x)]
            sums = np.empty(len(x) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(x, out=sums[1:])
            out[i:j] = (sums[e] - sums[s]) * self.inverse[s]
            i = j
        return out

    def plain(self, word: bytes) -> int:
        """The hash of one word, without arrays: for short words one at a time."""
        if len(word) > 64:
            return self.one(word)
        if not hasattr(self, "_lists"):
            self._lists = self.table.tolist(), self.power[:64].tolist()
        t, p = self._lists
        h = sum([t[b] * q for b, q in zip(word, p)]) & _ALL
        h = (h ^ (len(word) * int(_M1))) & _ALL
        h = ((h ^ (h >> 31)) * int(_M2)) & _ALL
        return h ^ (h >> 29)

    def one(self, word: bytes) -> int:
        """The hash of one word."""
        return int(self.prefix(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


class Table:
    """Open addressing from pairs of 64-bit hashes to row numbers, for whole arrays at a time.  A slot
    holds the first hash, and half of the second beside the row, so that a look takes one place in memory.

    Bounded: ``room`` says how many keys may still be added.
    """

    def __init__(self, entries: int):
        self.bits = max(4, int(2 * entries - 1).bit_length())
        self.limit = (1 << self.bits) // 2
        self.slots = np.zeros((1 << self.bits, 2), np.uint64)
        self.n = 0

    @property
    def room(self) -> int:
        return self.limit - self.n

    def _slot(self, h1: np.ndarray) -> np.ndarray:
        return ((h1 * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is absent."""
        out, left, at = np.full(len(h1), -1, np.int64), None, self._slot(h1 | np.uint64(1))
        h1, h2, mask, half = h1 | np.uint64(1), h2 >> np.uint64(32), (1 << self.bits) - 1, np.uint64(32)
        while len(at):
            got = self.slots.take(at, axis=0)
            k, v = got[:, 0], got[:, 1]
            hit = (k == h1) & ((v >> half) == h2)
            row = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
            if left is None:
                np.copyto(out, row, where=hit)
                left = np.flatnonzero(~hit & (k != 0))
                on = left
            else:
                out[left[hit]] = row[hit]
                on = np.flatnonzero(~hit & (k != 0))
                left = left[on]
            at, h1, h2 = (at[on] + 1) & mask, h1[on], h2[on]
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Row numbers of new, different keys, in their order."""
        rows = np.arange(self.n, self.n + len(h1), dtype=np.int64)
        h1 = h1 | np.uint64(1)
        value = ((h2 >> np.uint64(32)) << np.uint64(32)) | rows.astype(np.uint64)
        at, mask = self._slot(h1), (1 << self.bits) - 1
        while len(at):
            free = np.flatnonzero(self.slots[at, 0] == 0)
            # Of keys that want one slot the last that is written gets it.
            self.slots[at[free], 1] = value[free]
            won = free[self.slots[at[free], 1] == value[free]]
            self.slots[at[won], 0] = h1[won]
            on = np.ones(len(at), bool)
            on[won] = False
            at, h1, value = (at[on] + 1) & mask, h1[on], value[on]
        self.n += len(rows)
        return rows


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one of each key, number of each key's place there)."""
    by = np.argsort(h1)
    a, b = h1[by], h2[by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    back = np.empty(len(a), np.int64)
    back[by] = np.cumsum(new) - 1
    return by[new], back


def tidy() -> None:
    """Give memory that a task has freed back to the system; idle workers then hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
