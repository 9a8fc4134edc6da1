"""Words and hashed character n-grams of many texts at once, as numpy operations over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Bytes of words: letters, digits and whatever isn't ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32#: What is no part of a word becomes a blank, so that a word's n-grams don't depend on the marks beside it.
PLAIN = np.where(WORD, LOWER, 32).astype(np.uint8)

_SEEDS = np.random.default_rng(20240101).integers(1, 2**32, 16, dtype=np.uint32) | np.uint32(1)
_WORD_SEEDS = np.random.default_rng(20240102).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def spaced(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, blanks for what is no part of a word and one around each, and where each text starts (and the end)."""
    n = len(places) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    row = np.repeat(np.arange(1, n + 1), np.diff(places))
    out[np.arange(len(data)) + row] = PLAIN[data]
    # capital letters with an accent, two bytes in UTF-8
    wide = np.flatnonzero(out[:-1] == 0xC3) + 1
    wide = wide[(out[wide] >= 0x80) & (out[wide] <= 0x9E) & (out[wide] != 0x97)]
    out[wide] += 32
    return out, places + np.arange(n + 1) + 1


def words(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each word in spaced text."""
    edge = np.diff(WORD[text].view(np.int8), prepend=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return first, end, np.searchsorted(starts, first, "right") - 1


def gram_sums(text: np.ndarray, first: np.ndarray, end: np.ndarray, weights: np.ndarray, sizes=(3, 4, 5)) -> np.ndarray:
    """Per word the mean of weights[bucket] over its n-grams, the space on either side included.

    weights has one row per bucket, a power of two of them, and one column or none.
    """
    total, count = gram_pairs(text, first, end, weights.shape[0], sizes, weights)
    return total / np.maximum(count, 1).reshape(-1, *[1] * (weights.ndim - 1))


def _hashes(text: np.ndarray, sizes, bits: int):
    wide = text.astype(np.uint32)
    h = wide * _SEEDS[0]
    for n in range(2, max(sizes) + 1):
        if len(wide) < n:
            return
        h = h[: len(wide) - n + 1] + wide[n - 1 :] * _SEEDS[n - 1]
        if n in sizes:
            mixed = h ^ (h >> np.uint32(15))
            mixed = (mixed + np.uint32(n)) * np.uint32(0x9E3779B1)
            yield n, mixed >> np.uint32(32 - bits)


def gram_pairs(text, first, end, buckets: int, sizes=(3, 4, 5), weights=None):
    """With weights: sums of weights and counts of n-grams per word. Without: (word, bucket) of every n-gram."""
    bits = int(buckets).bit_length() - 1
    size = end - first + 2
    count = np.zeros(len(first), np.int64)
    total = np.zeros((len(first), *weights.shape[1:]), np.float32) if weights is not None else None
    found = []
    for n, bucket in _hashes(text, sizes, bits):
        many = np.maximum(size - n + 1, 0)
        count += many
        begin = np.cumsum(many) - many
        at = np.arange(int(many.sum())) - np.repeat(begin, many) + np.repeat(first - 1, many)
        got = bucket[at]
        if weights is None:
            found.append((np.repeat(np.arange(len(first)), many), got))
        else:
            some = np.flatnonzero(many)
            if len(some):
                total[some] += np.add.reduceat(weights[got], begin[some], axis=0)
    if weights is None:
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    return total, count


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of any length, from random odd factors by place."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = end - first
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    byte = text[place + np.repeat(first, size)].astype(np.uint64) + np.uint64(1)
    if int(size.max()) > len(_WORD_SEEDS):
        byte = mix(byte * np.uint64(0x9E3779B97F4A7C15) + (place // len(_WORD_SEEDS)).astype(np.uint64)) * (place >= len(_WORD_SEEDS)) + byte * (place < len(_WORD_SEEDS))
    return mix(np.add.reduceat(byte * _WORD_SEEDS[place % len(_WORD_SEEDS)], begin) + size.astype(np.uint64))
