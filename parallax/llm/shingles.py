"""Hashes of words and word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the words' polynomial hash (mod 2**64), its inverse, and the bytes hashed at once.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def white(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of the text with A-Z in small letters."""
    text = text.lower()
    if len(text) > PIECE:  # in pieces that end between words
        parts, start = [], 0
        raw = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero(white(raw))
        while start < len(text):
            at = np.searchsorted(gaps, start + PIECE)
            end = int(gaps[at]) + 1 if at < len(gaps) else len(text)
            parts.append(_hash_piece(raw[start:end]))
            start = end
        return np.concatenate(parts)
    return _hash_piece(np.frombuffer(text, np.uint8))


def _hash_piece(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~white(raw)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of `size` words, sorted; with fewer words the whole sequence as one; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(size, len(words))
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ words[i : len(words) - k + 1 + i]
    return np.unique(mix(out + np.uint64(k)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct values."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return bool(len(a)) and bool(len(b)) and 100 * shared >= percent * (len(a) + len(b) - shared)
