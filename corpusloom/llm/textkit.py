"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on whole Arrow batches of strings with numpy: no loop runs
over words or characters.  A *word* is a maximal run of ASCII letters, ASCII
digits and non-ASCII characters of the lower-cased text, so that the same
split can be written as the regular expression ``WORD`` in any engine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[0-9a-z\u0080-\U0010ffff]+"
#: Batches of texts are cut so that the arrays made for one stay small; a longer text is a batch of its own.
SLICE_BYTES = 1 << 21

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}
_IS_WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _IS_WORD[_c] = True
_IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(12345))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    key = str(base)
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        step, factor = 1, base
        while step < size:
            out[step : 2 * step] = out[:step] * np.uint64(factor)
            step, factor = 2 * step, factor * factor % (1 << 64)
        _POW[key] = have = out
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except AttributeError:  # not glibc
    _TRIM = None


def trim() -> None:
    """Give freed memory back to the system, so that workers that wait don't hold what others need."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes, or one row; memory is trimmed after the last."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop
    trim()


class Words:
    """Words of a batch: start and end bytes, row of each, first word of each row, 64-bit hash."""

    __slots__ = ("raw", "offsets", "start", "end", "row", "first", "hash")

    def __init__(self, texts: pa.Array, *, lower: bool = True, hashed: bool = True):
        if lower:
            texts = pc.utf8_lower(texts)
        raw, offsets = buffers(texts)
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = _IS_WORD[raw]
        edge = inside[1:] != inside[:-1]
        # a word ends where its text ends, even when the next text goes on with a word
        joint = offsets[1:-1]
        joint = np.unique(joint[(joint > 0) & (joint < n)])
        both = joint[inside[joint] & inside[joint + 1]]
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, both, both]))
        self.raw, self.offsets = raw, offsets
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        n = len(self.raw)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * _powers(_BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * _powers(_INV, n)[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, rows and first words of all n-word shingles inside rows; a row with fewer than n words (but any) has one, of all of them."""
        counts = np.diff(self.first)
        if n == 1:
            return self.hash, self.row, np.arange(len(self))
        m = len(self)
        acc = np.zeros(m, np.uint64)
        mul = np.uint64(0xD6E8FEB86659FD93)
        last = self.first[1:][self.row]
        for k in range(n):
            acc[: m - k] = acc[: m - k] * mul + self.hash[k:] if k else self.hash
            if k < n - 1:  # rows that end here keep the shorter shingle
                short = np.flatnonzero((counts > 0) & (counts == k + 1))
                if len(short):
                    keep = self.first[:-1][short]
                    acc_short = acc[keep].copy()
                    _keep = (keep, acc_short) if k == 0 else (np.concatenate([_keep[0], keep]), np.concatenate([_keep[1], acc_short]))
                elif k == 0:
                    _keep = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        acc = mix(acc)
        whole = np.arange(m) + n <= last
        acc[_keep[0]] = mix(_keep[1] + np.uint64(n))
        whole[_keep[0]] = True
        at = np.flatnonzero(whole)
        return acc[at], self.row[at], at


def words_of(text: str | None) -> list[str]:
    """The same words by regular expression, for brute-force versions."""
    import re

    return re.findall(WORD, pc.utf8_lower(pa.array([text or ""]))[0].as_py())
