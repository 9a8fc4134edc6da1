"""Benchmark decontamination: the q-gram lemma filters diagonal bands, and banded alignment verifies what is left."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import slices, utf8
from frameloom.llm.grams import WORD, mix, spaced

#: Bytes of a q-gram, edits per byte of a passage, and bytes of a passage: longer items are searched by passages of this size.
Q, EDITS, PASSAGE = 10, 0.06, 512
#: Parts of an item are found by passages of PART bytes, one every STRIDE bytes: no verbatim run of PART + STRIDE - 1 bytes is missed.
PART, STRIDE = 96, 24
#: Bytes of benchmark text whose index is broadcast at a time; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 24
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def normal(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words parted by single blanks; where each text starts in that, and the original place of each byte."""
    text, starts = spaced(data, places)
    word = WORD[text]
    keep = word.copy()
    keep[1:] |= word[:-1]  # one separator after each word
    origin = np.flatnonzero(keep)
    out = np.where(word[origin], text[origin], 32).astype(np.uint8)
    first = np.searchsorted(origin, starts)
    row = np.repeat(np.arange(-1, len(starts)), np.diff(np.concatenate([[0], first, [len(origin)]])))
    return out, first, origin - np.clip(row, 0, max(0, len(starts) - 2)) - 1


def _hashes(text: np.ndarray) -> np.ndarray:
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.append(text, np.zeros(8, np.uint8))
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(np.uint64).ravel()
    return mix(eight[:n] * _PRIME + (eight[Q - 8 : Q - 8 + n] ^ (eight[Q - 8 : Q - 8 + n] >> np.uint64(31))))


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Least edits between the whole pattern and a part of text, on diagonals (text place - pattern place) low to high; and the
    part's first and end place. Of equal ones the first end, then the last start, is taken."""
    width, far = high - low + 1, 1 << 28
    place = np.arange(low, high + 1)
    cost = np.where((place >= 0) & (place <= len(text)), 0, far).astype(np.int64)
    begin = place.copy()
    step = np.arange(width)
    for i in range(len(pattern)):
        at = place + i  # text byte that the diagonal step takes
        valid = (at >= 0) & (at < len(text))
        byte = text[np.clip(at, 0, max(0, len(text) - 1))] if len(text) else np.zeros(width, np.uint8)
        best = np.where(valid, cost + (byte != pattern[i]), far)
        start = begin.copy()
        up = np.append(cost[1:], far) + 1  # a pattern byte without one in the text
        better = up < best
        best = np.where(better & (at + 1 >= 0) & (at + 1 <= len(text)), up, best)
        start = np.where(better, np.append(begin[1:], 0), start)
        run = best - step  # text bytes without one in the pattern
        low_run = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == low_run, step, 0))
        cost, begin = np.minimum(low_run + step, far), start[source]
    ends = place + len(pattern)
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, far)
    k = int(cost.argmin())
    return int(cost[k]), int(begin[k]), int(ends[k])


class Index:
    """q-grams of a block of items, each once, and the passages that they are parts of."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.whole, self.short, keys = [], [], [], []
        for item, text in items:
            if item is None or not text:
                continue
            whole, _, _ = normal(*utf8(pa.array([text], pa.large_string())))
            whole = whole[: len(whole) - (len(whole) > 0 and whole[-1] == 32)]
            if len(whole) >= Q:
                keys.append(_hashes(whole))
                self.item.append(item), self.whole.append(whole)
            elif len(whole):
                self.short.append((item, whole.tobytes()))
        many = np.array([len(h) for h in keys], np.int64)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.owner = np.repeat(np.arange(len(many)), many)[order]
        self.place = (np.arange(len(self.keys)) - np.repeat(np.cumsum(many) - many, many))[order]
        self.keys = self.keys[order]
        self.length = many + Q - 1
        # an item of up to PASSAGE bytes whole, or passages half over each other; then the parts, of which the last ends with the item
        self.n_large = np.where(self.length <= PASSAGE, 1, -(-(self.length - PASSAGE // 2) // (PASSAGE // 2)))
        self.n_parts = np.where(self.length > PART, -(-(self.length - PART) // STRIDE) + 1, 0)
        total = self.n_large + self.n_parts
        self.first = np.cumsum(total) - total
        self.of = np.repeat(np.arange(len(total)), total)
        number = np.arange(len(self.of)) - self.first[self.of]
        large, length = number < self.n_large[self.of], self.length[self.of]
        self.begin = np.where(large, number * (PASSAGE // 2), np.minimum((number - self.n_large[self.of]) * STRIDE, length - PART))
        self.size = np.where(large, np.minimum(PASSAGE, length - self.begin), PART)
        self.large = large
        self.budget = np.minimum((EDITS * self.size).astype(np.int64), np.maximum(0, self.size - Q) // Q)
        self.need = self.size - Q + 1 - Q * self.budget
        self.least = np.minimum.reduceat(self.need, self.first) if len(self.first) else np.zeros(0, np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def _covering(self, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, passage) of every passage that holds the hit's q-gram."""
        tries = [place // (PASSAGE // 2) - k for k in range(2)]
        parts = [place // STRIDE - k for k in range(PART // STRIDE)]
        hits, passages = [], []
        last = self.n_parts[item] - 1
        for number, low, high in (*((x, 0, self.n_large[item]) for x in tries), *((self.n_large[item] + x, self.n_large[item], self.n_large[item] + last) for x in parts), (self.n_large[item] + last, self.n_large[item], self.n_large[item] + last + 1)):
            some = np.flatnonzero((number >= low) & (number < high))
            passage = self.first[item[some]] + number[some]
            inside = (self.begin[passage] <= place[some]) & (place[some] + Q <= self.begin[passage] + self.size[passage])
            hits.append(some[inside]), passages.append(passage[inside])
        return np.concatenate(hits), np.concatenate(passages)

    def _candidates(self, text: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, passage, band) with as many of the passage's q-grams in a band of diagonals as the budget of edits leaves."""
        h = _hashes(text)
        if not len(h) or not len(self.keys):
            return []
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        left = np.searchsorted(self.keys, h[at], "left")
        many = np.searchsorted(self.keys, h[at], "right") - left
        at, left, many = at[many > 0], left[many > 0], many[many > 0]
        if not len(at):
            return []
        entry = np.arange(int(many.sum())) + np.repeat(left - (np.cumsum(many) - many), many)
        at = np.repeat(at, many)
        row, item, place = np.searchsorted(starts, at, "right") - 1, self.owner[entry], self.place[entry]
        # too few q-grams of the item for any passage
        _, pair, count = np.unique(row * len(self.item) + item, return_inverse=True, return_counts=True)
        some = count[pair] >= self.least[item]
        at, row, item, place = at[some], row[some], item[some], place[some]
        hit, passage = self._covering(item, place)
        if not len(hit):
            return []
        row, place, diagonal = row[hit], place[hit], (at - starts[row] - place)[hit] + (1 << 20)
        # bands of twice budget + 1 diagonals, each half of which is in two of them
        band = diagonal // (self.budget[passage] + 1)
        # a q-gram of the passage counts once in a band, however often it is hit there
        key = np.stack([np.tile(row, 2), np.tile(passage, 2), np.concatenate([band, band - 1]), np.tile(place, 2)])
        group = key[:, np.lexsort(key[::-1])]
        new = np.ones(group.shape[1], bool)
        new[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0)
        group = group[:, new]
        edge = np.flatnonzero(np.append(True, (group[:3, 1:] != group[:3, :-1]).any(axis=0)))
        count = np.diff(np.append(edge, group.shape[1]))
        return list(map(tuple, group[:3, edge[count >= self.need[group[1, edge]]]].T.tolist()))

    def _part(self, own: np.ndarray, item: int, held: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        """(first, end, edits, passage bytes) of the whole item, or else of its longest part, within own."""
        whole, raw, hits = self.whole[item], own.tobytes(), []
        for p, band in held:  # large passages come first
            begin, size, budget = int(self.begin[p]), int(self.size[p]), int(self.budget[p])
            low = band * (budget + 1) - (1 << 20) + begin
            low, high = low - (budget + 1), low + 3 * (budget + 1)
            if not self.large[p]:
                if hits and self.length[item] <= PASSAGE and hits[0][1] == self.length[item]:
                    break  # the item is there whole
                if any(a <= begin and begin + size <= z and low <= first - a + begin <= high for a, z, first, _, _ in hits):
                    continue
            pattern = whole[begin : begin + size]
            exact = raw.find(pattern.tobytes(), max(0, low), max(0, high + size))
            edits, first, end = (0, exact, exact + size) if exact >= 0 else align(pattern, own, low, high)
            if edits <= budget:
                hits.append((begin, begin + size, first, end, edits))
        # adjoining passages on about the same diagonal are one region, if that is within the budget as a whole
        regions = []
        for a, z, first, end, _ in sorted(hits):
            slack = int(EDITS * (z - a)) + 1
            for region in reversed(regions):
                if a <= region[1] and abs(first - a - region[3]) <= slack:
                    region[1], region[2], region[3], region[4] = max(region[1], z), [*region[2], first - a], first - a, max(region[4], slack)
                    break
            else:
                regions.append([a, z, [first - a], first - a, slack])
        for a, z, diagonals, _, slack in regions:
            if len(diagonals) > 1:
                edits, first, end = align(whole[a:z], own, min(diagonals) + a - slack, max(diagonals) + a + slack)
                if edits <= int(EDITS * (z - a)):
                    hits.append((a, z, first, end, edits))
        best = min(hits, key=lambda x: (x[0] - x[1], x[4], x[2]), default=None)
        return best and (best[2], best[3], best[4], best[1] - best[0])

    def _short(self, text: np.ndarray, starts: np.ndarray):
        """(row, item, first, end, 0, bytes) of the first exact occurrence, as whole words, of items with fewer than Q bytes."""
        raw = text.tobytes() if self.short else b""
        for item, pattern in self.short:
            at, seen = raw.find(pattern + b" "), -1
            while at >= 0:
                row = int(np.searchsorted(starts, at, "right")) - 1
                if row > seen and (at == starts[row] or raw[at - 1] == 32) and at + len(pattern) < starts[row + 1]:
                    seen = row
                    yield row, item, at - int(starts[row]), at - int(starts[row]) + len(pattern), 0, len(pattern)
                at = raw.find(pattern + b" ", at + 1)

    def search(self, data: np.ndarray, places: np.ndarray):
        """Per text and item the best part within the edit budget: (text, item, first byte, end byte, edits, passage bytes)."""
        text, starts, origin = normal(data, places)
        held: dict[tuple[int, int], list] = {}
        for row, p, band in self._candidates(text, starts):
            held.setdefault((row, int(self.of[p])), []).append((p, band))
        found = {}
        for (row, k), passages in held.items():
            part = self._part(text[starts[row] : starts[row + 1]], k, passages)
            if part:
                where = (row, self.item[k])
                found[where] = min(found.get(where, part), part, key=lambda x: (-x[3], x[2], x[0]))
        for row, item, *part in self._short(text, starts):
            found.setdefault((row, item), tuple(part))
        last = lambda r, x: int(origin[starts[r] + x - 1]) + 1
        return [(r, item, int(origin[starts[r] + first]) - int(places[r]), last(r, end) - int(places[r]), edits, size) for (r, item), (first, end, edits, size) in sorted(found.items())]


_KEPT: dict[str, Index] = {}


def _index(key: str, items: list[tuple[int, str]]) -> Index:
    """The index of a block, made once per worker process; one is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Index(items)
    return _KEPT[key]


def _blocks(benchmark: DataFrame):
    """The items in blocks of about BLOCK_BYTES, one after another, so that the driver never holds more."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    for k in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and benchmark item that it holds: doc_id, item_id, start, stop (bytes of the text), edits, passage_bytes.

    A document holds an item if a part of it turns into the item, or into a passage of PART or PASSAGE bytes of it, by edits of
    at most EDITS of the passage's bytes, both with lower-cased words parted by single blanks. A whole item of up to PASSAGE
    bytes is given if it is there, else the longest part; adjoining passages are one. Items with fewer than Q such bytes are
    found as whole words without edits; those without words and null ones aren't searched. Null and empty texts hold nothing;
    repeated rows give repeated results. A narrow map per block of the benchmark; nothing is shuffled.
    """
    out = None
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def go(batches, shared=shared, key=uuid.uuid4().hex):
            index = _index(key, shared.value)
            for part in slices(batches):
                found = index.search(*utf8(part.column(1)))
                if found:
                    rows = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[0])), *(pa.array(c, pa.int64()) for c in rows[1:])], ["doc_id", "item_id", "start", "stop", "edits", "passage_bytes"])

        one = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null").mapInArrow(go, "doc_id long, item_id long, start long, stop long, edits long, passage_bytes long")
        out = one if out is None else out.unionByName(one)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they were, that hold no item; a map per block of the benchmark."""
    place = docs.columns.index("text")
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def go(batches, shared=shared, key=uuid.uuid4().hex):
            index = _index(key, shared.value)
            for part in slices(batches, place):
                stay = np.ones(part.num_rows, bool)
                stay[[x[0] for x in index.search(*utf8(part.column(place)))]] = False
                yield part.filter(pa.array(stay))

        docs = docs.mapInArrow(go, docs.schema)
    return docs
