"""Vectorised text kernels over Arrow string columns: word bounds, rolling
hashes, and repeats within documents. All take whole columns, not rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(_rng.integers(2**40, 2**60)) * 8 + 5
BASE_INV = pow(BASE, -1, 2**64)
WORD_BASE = U64(int(_rng.integers(2**40, 2**60)) * 8 + 3)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i for i below 4096, and base**(4096 i), so that no table grows with a text."""
    if base not in _powers or len(_powers[base][1]) * 4096 < n:
        small = np.multiply.accumulate(np.r_[U64(1), np.full(4095, base % 2**64, np.uint64)])
        large = np.multiply.accumulate(np.r_[U64(1), np.full(max(1024, n // 4096 * 2), pow(base, 4096, 2**64), np.uint64)])
        _powers[base] = small, large
    return _powers[base]


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i below n."""
    small, large = _tables(base, n)
    return np.multiply.outer(large[: n // 4096 + 1], small).ravel()[:n]


def powers_at(base: int, at: np.ndarray) -> np.ndarray:
    small, large = _tables(base, int(at.max(initial=0)) + 1)
    return large[at >> 12] * small[at & 4095]


@dataclass
class Texts:
    """Bytes of a column of texts, end to end; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array, lower: bool = False) -> Texts:
    """Null counts as the empty text. lower: A-Z only."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return Texts(LOWER[data] if lower else data, offsets - offsets[0])


def spans(texts: Texts, gap: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gap`` (by byte) within each text; ``cut``: where a run also ends, by position."""
    inside = ~gap[texts.data]
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    if cut is not None:
        edge[:n] |= cut
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from one running polynomial."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    codes = BYTE_CODE[data]
    codes *= powers(BASE, n)
    np.cumsum(codes, out=total[1:])
    del codes
    h = (total[ends] - total[starts]) * powers_at(BASE_INV, starts)
    return mix(h + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a column of texts. Words of text i: offsets[i] to offsets[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def words_of(texts: Texts, gap: np.ndarray = SPACE, cut: np.ndarray | None = None) -> Words:
    starts, ends = spans(texts, gap, cut)
    return Words(starts, ends, np.searchsorted(starts, texts.offsets), span_hashes(texts.data, starts, ends))


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of n consecutive words that lie in one text, and the first word's index."""
    counts = np.diff(offsets)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    rolled = hashes[:m].copy()
    for k in range(1, n):
        rolled *= WORD_BASE
        rolled += hashes[k : k + m]
    room = np.repeat(offsets[1:], counts)[:m] - np.arange(m) >= n
    at = np.flatnonzero(room)
    return mix(rolled[at]), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once. Sorting finds the few repeated values first."""
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return np.zeros(len(keys), bool)
    again = again[np.r_[True, again[1:] != again[:-1]]]
    return member(again, keys)


def member(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array. A table by the top 18 bits passes the few that need a search."""
    some = np.zeros(1 << 18, bool)
    some[ordered >> U64(46)] = True
    out = some[keys >> U64(46)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(ordered, keys[maybe])
    at[at == len(ordered)] = 0
    out[maybe] = ordered[at] == keys[maybe]
    return out


def per_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return mix(keys + text.astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def covered(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of ``length`` from any of ``first``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1) if len(first) < 64 else np.add(step[:n], np.bincount(first, minlength=n)[:n], out=step[:n], casting="unsafe")
    ends = np.minimum(first + length, n)
    step -= np.bincount(ends, minlength=n + 1).astype(np.int32)[: n + 1]
    return np.cumsum(step[:n]) > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]], also for empty runs."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
