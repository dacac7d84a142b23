"""Canonical length-limited Huffman codes over token ids, coded and decoded with NumPy.

Code lengths come from global counts by package-merge. A stream is cut into blocks of LANES runs of RUN ids;
the bit offset of each run is a checkpoint, so that any run can be decoded alone and all runs of a block, or
of many blocks, are decoded side by side by one table of 2**LIMIT entries.
"""

from __future__ import annotations

import numpy as np

LIMIT = 20
RUN = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits; 0 where the count is 0 (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    # each level: weights of single coins merged with packages of two from the level below
    singles_at: list[np.ndarray] = []
    level, is_single = coins, np.ones(len(coins), bool)
    singles_at.append(is_single)
    for _ in range(limit - 1):
        packed = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, packed])
        rank = np.argsort(both, kind="stable")
        level, is_single = both[rank], rank < len(coins)
        singles_at.append(is_single)
    take = 2 * (len(coins) - 1)
    depth = np.zeros(len(coins), np.int64)
    for is_single in reversed(singles_at):
        single = int(is_single[:take].sum())
        depth[:single] += 1
        take = 2 * (take - single)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words in canonical order: shorter first, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        size = lengths[order].astype(np.int64)
        steps = np.left_shift(np.int64(1), LIMIT - size)
        codes[order] = (np.concatenate([[0], np.cumsum(steps)[:-1]]) >> (LIMIT - size)).astype(np.uint64)
    return codes


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for each value of the next LIMIT bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    repeat = np.left_shift(np.int64(1), LIMIT - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    end = int(repeat.sum())
    symbol[:end], size[:end] = np.repeat(order, repeat), np.repeat(lengths[order], repeat)
    return symbol, size


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, most significant first, padded to whole words; the bit offset of each run of RUN ids)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(ids) else 0
    if not total:
        return b"", np.zeros(0, np.uint32)
    room = 64 - (start & 63) - size
    code = codes[ids]
    head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    word = start >> 6
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((total >> 6) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(head, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), start[::RUN].astype(np.uint32)


def decode(bits: np.ndarray, starts: np.ndarray, counts: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids of runs that begin at bit offsets `starts` and hold `counts` ids (RUN at most), one after another."""
    padded = np.concatenate([bits, np.zeros(16, np.uint8)])
    at = starts.astype(np.int64)
    out = np.zeros((RUN, len(at)), np.uint32)
    order = np.argsort(-counts, kind="stable")
    at, live = at[order], counts[order]
    for step in range(int(live[0]) if len(live) else 0):
        n = int(np.searchsorted(-live, -step, "left"))
        here = at[:n]
        byte = here >> 3
        value = (padded[byte].astype(np.uint32) << 24) | (padded[byte + 1].astype(np.uint32) << 16) | (padded[byte + 2].astype(np.uint32) << 8) | padded[byte + 3]
        peek = (value >> (32 - LIMIT - (here & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
        out[step, order[:n]] = symbol[peek]
        at[:n] = here + size[peek]
    return out.T[np.arange(RUN) < counts[:, None]]
