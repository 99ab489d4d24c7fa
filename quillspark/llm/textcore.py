"""Vectorised text primitives shared by the training-data operators.

Everything here works on one slice of an Arrow batch at a time: the texts of the
slice are joined into one code-point array, and words, hashes and shingles are
numpy arrays over it, so the cost is some tens of nanoseconds a character and
never a Python loop over words.

Words are maximal runs of letters and digits (``str.isalnum``), lower-cased.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x = x * _MIX2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case map (one code point to one) and word-character flags by code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    word = np.zeros(0x110000, dtype=bool)
    for c in [*range(0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200)]:
        s = chr(c)
        if s.isalnum():
            word[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return lower, word


_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the tables grow by doubling and are reused."""
    while len(_pow[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            old = _pow[k]
            _pow[k] = np.concatenate([old, old * np.uint64(pow(base, len(old), 1 << 64))])
    return _pow[0], _pow[1]


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters; a longer text is a range of its own, never cut."""
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def text_slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """Row ranges of about ``limit`` bytes of an Arrow column with their texts: only one range is held as Python strings at a time."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()
        lo = hi


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it keeps what it has
        return None


def give_back() -> None:
    """Return freed memory to the system; workers live on between tasks, and what each keeps adds up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line end behind each, and where each begins (one entry more than texts)."""
    raw = np.frombuffer(("\n".join([t or "" for t in texts]) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    return raw, np.concatenate([[0], np.cumsum(lengths)])


def prefix_sums(cp: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash over code points."""
    up, _ = powers(len(cp) + 1)
    terms = (cp.astype(np.uint64) + np.uint64(0x51)) * _MIX1
    terms ^= terms >> np.uint64(29)
    terms *= up[: len(terms)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])


class Words:
    """The words of some texts.

    ``start``/``end``: character positions in the joined text; ``offset[d]``: first
    word of text d (one entry more than texts); ``base[d]``: where text d begins;
    ``hash``: 64-bit hash by word; ``cp``: code points, lower-cased.
    """

    def __init__(self, texts: list[str | None], hashed: bool = True):
        lower, word = char_tables()
        self.raw, self.base = joined(texts)
        self.cp = lower[self.raw]
        is_word = word[self.raw]
        edge = np.diff(is_word.view(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.offset = np.searchsorted(self.start, self.base)
        self.counts = np.diff(self.offset)
        if hashed:
            self.hash = self.span_hash(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def prefix(self) -> np.ndarray:
        """Prefix sums of the polynomial hash over the lower-cased code points."""
        if not hasattr(self, "_prefix"):
            self._prefix = prefix_sums(self.cp)
        return self._prefix

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self.prefix()
        _, down = powers(len(self.cp) + 1)
        return mix((p[end] - p[start]) * down[start] + np.uint64(1))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within one text, and their offsets by text."""
        n = len(self)
        counts = np.maximum(self.counts - (k - 1), 0)
        offset = np.concatenate([[0], np.cumsum(counts)])
        if n < k or not offset[-1]:
            return np.zeros(0, np.uint64), offset
        m = n - k + 1
        h = self.hash[:m].copy()
        for j in range(1, k):
            h *= _SHINGLE
            h += self.hash[j : j + m]
        valid = np.ones(n, bool)
        ends = self.offset[1:]
        for j in range(1, k):  # the last k-1 words of each text begin no shingle
            at = ends - j
            valid[at[at >= self.offset[:-1]]] = False
        return mix(h[valid[:m]]), offset


def segment_sum(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Sum of values by segment; empty segments give 0."""
    c = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return c[offset[1:]] - c[offset[:-1]]


def segment_reduce(op: np.ufunc, values: np.ndarray, offset: np.ndarray, empty) -> np.ndarray:
    """op.reduceat that gives ``empty`` for empty segments."""
    n = np.diff(offset)
    out = np.full((len(n), *values.shape[1:]), empty, values.dtype)
    full = n > 0
    if full.any():
        out[full] = op.reduceat(values, offset[:-1][full], axis=0)
    return out


def simhash64(hashes: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each segment of feature hashes (every occurrence votes); an empty segment has 0."""
    n = np.diff(offset)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    for lo in range(0, len(full), 4096):
        rows = full[lo : lo + 4096]
        a, b = offset[rows[0]], offset[rows[-1] + 1]
        bits = np.zeros((len(rows), 64), bool)
        at = offset[rows] - a
        h = hashes[a:b]
        for k in range(64):
            votes = np.add.reduceat(((h >> np.uint64(k)) & np.uint64(1)).astype(np.int64), at)
            bits[:, k] = 2 * votes > n[rows]
        out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out
