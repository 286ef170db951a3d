"""Length-limited canonical Huffman codes over numpy arrays of ids."""

from __future__ import annotations

import numpy as np

#: Longest code; the decoding table has 2**LIMIT entries.
LIMIT = 18
#: A bit offset is kept for every so many ids.
STEP = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur.

    Each level merges the single ids with the pairs of the level below, by
    weight. How many singles each level takes gives the lengths."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    single, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        both = both[order]
        single.append(order < len(weight))
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for is_single in reversed(single):
        n = int(is_single[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = previous = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for size in np.unique(lengths[order]):
        ids = order[lengths[order] == size]
        code <<= int(size) - previous
        codes[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code, previous = code + len(ids), int(size)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each ``limit`` bits: the id that they begin with, and its length."""
    codes, ids, sizes = canonical(lengths), np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    if len(order):
        width = np.int64(1) << (limit - lengths[order].astype(np.int64))
        start = int(codes[order[0]]) << (limit - int(lengths[order[0]]))
        end = start + int(width.sum())
        ids[start:end], sizes[start:end] = np.repeat(order, width), np.repeat(lengths[order], width)
    return ids, sizes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """Bits of one block, padded to 8 bytes; their number; the offset of each STEP-th id."""
    size = lengths[ids].astype(np.int64)
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    bits, at = int(at[-1]), at[:-1]
    code, word = codes[ids].astype(np.uint64), at >> 6
    room = 64 - (at & 63) - size
    words = np.zeros((bits + 63 >> 6) + 1, np.uint64)
    if len(ids):
        part = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] = np.bitwise_or.reduceat(part, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words[: bits + 63 >> 6].byteswap().tobytes(), bits, at[::STEP].astype(np.int32)


def decode(payload: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """The n ids of one block. All offsets are followed at once, STEP ids each."""
    ids, sizes = table
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at, last = offsets.astype(np.int64), len(window) - 1
    out = np.zeros((STEP, len(at)), np.uint32)
    for k in range(min(STEP, n)):
        bits = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - limit)
        out[k] = ids[bits]
        at += sizes[bits]
    return out.T.ravel()[:n]
