"""Sets of word shingles of whole texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from frameloom.llm.common import utf8
from frameloom.llm.grams import LOWER, mix, word_hashes

#: Words of a shingle.
SIZE = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FACTORS = np.random.default_rng(20240103).integers(1, 2**63, SIZE, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; A-Z in lower case, words parted by blanks and bytes 9 to 13.

    A text of one to four words has one shingle, all of them. Null, empty and blank texts have none.
    """
    data, places = utf8(column)
    rows = len(places) - 1
    text = np.full(len(data) + rows + 1, 32, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(places))] = LOWER[data]
    starts = places + np.arange(rows + 1) + 1
    edge = np.diff((~_SPACE[text]).view(np.int8), prepend=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = word_hashes(text, first, end)
    bounds = np.searchsorted(first, starts)
    n = len(h)
    full = np.zeros(n, np.uint64)
    for k in range(SIZE):
        full[: n - k] += mix(h[k:] + np.uint64(k)) * _FACTORS[k]
    full = mix(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SIZE:
            out.append(np.unique(full[a : b - SIZE + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(31) + h[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
