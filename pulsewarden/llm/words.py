"""Vectorised word splitting and hashing over UTF-8 bytes.

A word is a maximal run of characters other than U+0000-002F, U+003A-0060 (after A-Z became a-z) and
U+007B-007F, so digits, a-z and everything beyond ASCII. In UTF-8 each such character is made of bytes
of the same classes, so the split can be done on bytes.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True

_GENERATOR = np.random.Generator(np.random.PCG64(20240229))
_OF_BYTE = _GENERATOR.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, down: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the hash's base modulo 2**64, or of its inverse."""
    kind, base = ("down", _INVERSE) if down else ("up", _BASE)
    if len(_powers[kind]) < n:
        full = np.full(max(n, 1 << 20), base, np.uint64)
        full[0] = 1
        _powers[kind] = np.multiply.accumulate(full)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo 2**64; piece() gets the hash of any stretch from it.

    For stretches of some hundred bytes at most, or where equal hashes only suggest equal stretches: longer ones can
    be made that collide.
    """
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * powers(len(data)), out=sums[1:])
    return sums


def piece(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch start:end, the same wherever the stretch stands."""
    raw = (sums[end] - sums[start]) * powers(len(sums), True)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Key of word hashes, and bytes from which a word is hashed on its own.
_KEY = 0x5851F42D4C957F2D
_LONG = 256


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each stretch start:end, mixed in anew after each eight bytes.

    A polynomial modulo 2**64 would not do: words of 1024 letters can be made that it cannot tell apart whatever its base.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(_KEY))
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    rest = np.flatnonzero(size <= _LONG)
    done = 0
    while len(rest):
        left = size[rest] - done
        keep = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * (left % 8)).astype(np.uint64)) - np.uint64(1))
        out[rest] = mix(out[rest] ^ eights[start[rest] + done] & keep)
        done += 8
        rest = rest[left > 8]
    for k in np.flatnonzero(size > _LONG).tolist():
        raw = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=_KEY.to_bytes(8)).digest()
        out[k] = np.frombuffer(raw, "<u8")[0]
    return out


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray  # word offsets of each row, one more than rows


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows whose bytes lie between offsets; start and end count bytes in data."""
    low = LOWER[data]
    inside = IN_WORD[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.append(inside[1:], False) if len(data) else inside
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return Words(start, end, word_hash(low, start, end), np.searchsorted(start, offsets))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets) of each row's n-word runs, in order and with repeats.

    A row of fewer than n words, but not none, has one shingle of all its words.
    """
    count = np.diff(words.rows)
    per_row = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    rows = np.zeros(len(count) + 1, np.int64)
    np.cumsum(per_row, out=rows[1:])
    if not rows[-1]:
        return np.empty(0, np.uint64), rows
    at = np.arange(rows[-1]) - np.repeat(rows[:-1], per_row) + np.repeat(words.rows[:-1], per_row)
    whole = np.repeat(count >= n, per_row)
    total = np.zeros(len(at), np.uint64)
    step = powers(n + 1)
    padded = np.append(words.hash, np.zeros(n, np.uint64))
    left = np.repeat(count, per_row)
    for k in range(n):
        value = padded[at + k] * step[k + 1]
        total += np.where(whole | (k < left), value, np.uint64(0))
    return mix(total), rows
