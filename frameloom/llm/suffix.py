"""Suffix-array dedup: bytes of 100-byte strings that also start earlier are removed, by merging shard Burrows-Wheeler transforms.

1. Every text is cut into runs of 100-byte windows with the same minimizer (least hash of a 16-byte string in the window). Equal
   windows have equal minimizers, so they meet in one bucket, whatever their documents. A run travels as hashes; one that equals
   an earlier run as a whole is a repeat as a whole, wherever it occurs, and a run alone with its minimizer holds no repeat.
2. The other runs' bytes are fetched. In each bucket they are trimmed to windows whose rolling hash occurs twice, equal strings
   collapse to their earliest place, and the strings are dealt to shards.
   A minimizer with very many runs (counted before) would be one task's: its runs are split into their windows, which meet by
   their own hashes, each different window once a slice.
3. Each shard gets its Burrows-Wheeler transform. The transforms are merged by refining their interleave: each round deals the
   interleave out by the symbol before each suffix, four bytes at a time, which orders it by four bytes more. Boundaries that
   appear on the way are the common prefixes; after 25 rounds what isn't parted shares 100 bytes: the repeated intervals.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import shuffle_parts, slices, utf8, written
from frameloom.llm.grams import mix

#: Bytes of a window, of the strings whose hashes compete within it, and of a symbol of the transforms.
WINDOW, Q, SYMBOL = 100, 16, 4
#: Windows of a run, shards of a merge, and symbols merged at a time (more if one bucket key alone has more).
RUN, SHARDS, MERGE = 256, 4, 1 << 20
#: Runs whose places are looked at together, and bytes of a bucket's runs that are trimmed and merged together (more if one key has more).
RUNS_AT_ONCE, MERGE_BYTES = 1 << 13, 2 << 20
#: Bits of a place in a text; those above tell several texts of one doc_id apart.
PLACE_BITS = 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return h if span == width else np.minimum(h[: len(h) - (width - span)], h[width - span :])


def _powers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of powers before each byte and inverse powers: (sum at the end - sum at the start) * inverse at the start is a string's hash."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(n, _PRIME, np.uint64)), out=total[1:])
    return total, np.cumprod(np.full(n, np.uint64(pow(int(_PRIME), -1, 2**64)), np.uint64))


def runs(data: np.ndarray, places: np.ndarray):
    """Runs of windows: document, first window, number of windows, minimizer, hash of the run's bytes, and whether its
    minimizer occurs in it more than once, without which it can't repeat itself."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    h = mix(eight[: n - Q + 1] * _PRIME + (eight[8 : n - Q + 9] ^ (eight[8 : n - Q + 9] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    least = _sliding_min(h, WINDOW - Q + 1)  # of the window at each byte
    doc = np.repeat(np.arange(len(places) - 1), np.diff(places))
    inside = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1 : n - WINDOW + 1] != doc[: n - WINDOW])
    new |= ~inside
    edge = np.flatnonzero(new)
    size = np.diff(np.append(edge, len(least)))
    keep = inside[edge]
    edge, size = edge[keep], size[keep]
    if len(size) and size.max() > RUN:
        cut = -(-size // RUN)
        k = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
        first = np.repeat(edge, cut) + k * RUN
        size = np.minimum(np.repeat(edge + size, cut) - first, RUN)
        edge = first
    # hash of the bytes, from sums of powers over the whole slice
    total, inverse = _powers(data)
    end = edge + size + WINDOW - 1
    content = mix((total[end] - total[edge]) * inverse[edge] + size.astype(np.uint64))
    key = least[edge]
    again = np.zeros(len(edge), bool)
    for a in range(0, len(edge), RUNS_AT_ONCE):  # runs overlap, so that theirs are some times the slice's places
        width = size[a : a + RUNS_AT_ONCE] + WINDOW - Q
        at = _expand(edge[a : a + RUNS_AT_ONCE], width)
        again[a : a + RUNS_AT_ONCE] = np.add.reduceat((h[at] == np.repeat(key[a : a + RUNS_AT_ONCE], width)).astype(np.int32), np.cumsum(width) - width) > 1
    return doc[edge], edge - places[doc[edge]], size, key, content, again


RECORD = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("size", "<u2"), ("again", "?")])
#: A record with its first byte in the slice.
PLACED = np.dtype([*((f, RECORD[f].str) for f in RECORD.names), ("at", "<i8")])
PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("size", "<u2")])


def _first_of(records: np.ndarray, fields=("key", "content")) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by fields, document and start, and for each the index of the first of its kind."""
    records = records[np.lexsort([records[f] for f in ("start", "doc", *fields[::-1])])]
    new = np.ones(len(records), bool)
    if len(records):
        new[1:] = np.any([records[f][1:] != records[f][:-1] for f in fields], axis=0)
    return records, np.flatnonzero(new)[np.cumsum(new) - 1]


def _later(records: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a record starts after the first of its kind (a repeated row of one document doesn't)."""
    f = records[first]
    return (records["doc"] > f["doc"]) | ((records["doc"] == f["doc"]) & (records["start"] > f["start"]))


def _spans(doc: np.ndarray, start: np.ndarray, size: np.ndarray):
    """One row per document: its removed runs of windows, of which adjacent ones are one."""
    order = np.lexsort((start, doc))
    doc, start, size = doc[order].astype(np.int64), start[order].astype(np.int64), size[order].astype(np.int64)
    if len(doc):
        edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + size[:-1])))
        last = np.append(edge[1:], len(doc)) - 1
        doc, start, size = doc[edge], start[edge], start[last] + size[last] - start[edge]
    at = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)) if len(doc) else []
    return [(int(doc[a]), np.stack([start[a:b], size[a:b]], 1).tobytes()) for a, b in zip(at, [*at[1:], len(doc)])]


def _batch(rows, types, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)


_TAGGED = ([pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["bucket", "doc", "blob", "text"])
TAGGED = "bucket long, doc long, blob binary, text binary"


#: Bytes of text a cell of minimizers on average, and runs (different ones of a slice) from which on a cell may be hot.
CELL_BYTES, HOT_RUNS = 8 << 20, 1 << 12
#: Counts that travel together.
CELL_ROW = 1 << 12


def _cell(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - bits)).astype(np.int64)


def _counts(bits: int):
    """Runs per cell of minimizers, each once a slice: rows of CELL_ROW counts, one at most per task and row."""

    def go(batches):
        total = np.zeros(1 << bits, np.uint32)
        for part in slices(batches, column=0, limit=3 << 19):
            _, _, _, key, content, _ = runs(*utf8(part.column(0)))
            _, first = np.unique(mix(key + content * _PRIME), return_index=True)
            cell, many = np.unique(_cell(key[first], bits), return_counts=True)
            total[cell] += many.astype(np.uint32)
        table = total.reshape(-1, CELL_ROW)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([table[k].tobytes() for k in some], pa.binary())], ["row", "counts"])

    return go


def _over(limit: int):
    """Rows of counts, sorted by row: of each a bit per cell, whether the sum is over the limit; rows without one are left out."""

    def go(batches):
        for row, held in _sums(batches):
            if (held > limit).any():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([np.packbits(held > limit).tobytes()], pa.binary())], ["row", "counts"])

    return go


def _sums(batches):
    row, held = None, None
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != row:
                if held is not None:
                    yield row, held
                row, held = k, np.zeros(CELL_ROW, np.int64)
            held += np.frombuffer(counts, np.uint32)
    if held is not None:
        yield row, held


def hot_cells(texts: DataFrame, n_bytes: int) -> tuple[int, np.ndarray]:
    """Bits of a cell's number, and whether each cell of minimizers has more runs than four times the average (and HOT_RUNS).

    All texts are counted. The driver gets a bit per cell, at most one per CELL_BYTES of text and 65,536 at least, so no text
    or minimizer.
    """
    bits = max(16, (n_bytes // CELL_BYTES).bit_length())
    limit = max(HOT_RUNS, 8 * n_bytes // (WINDOW - Q + 2) >> bits)  # a run begins at every 43rd byte of a text on average
    counts = texts.select("text").mapInArrow(_counts(bits), "row long, counts binary")
    over = counts.repartition(shuffle_parts(texts.sparkSession), "row").sortWithinPartitions("row").mapInArrow(_over(limit), "row long, counts binary")
    hot = np.zeros((1 << bits) // CELL_ROW * (CELL_ROW // 8), np.uint8).reshape(-1, CELL_ROW // 8)
    for r in over.collect():
        hot[r["row"]] = np.frombuffer(r["counts"], np.uint8)
    return bits, hot.ravel()


def _split(r: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The windows of runs of hot minimizers, each a run with a key of its own, so that they part into as many groups as there are texts."""
    total, inverse = _powers(data)
    size = r["size"].astype(np.int64)
    own, at = np.repeat(np.arange(len(r)), size), _expand(r["at"], size)
    out = r[own]
    out["start"] += at - out["at"]
    out["at"] = at
    out["content"] = mix((total[at + WINDOW] - total[at]) * inverse[at] + np.uint64(1))
    out["key"] = mix(out["key"] + out["content"] * _PRIME)
    out["size"], out["again"] = 1, False
    return out


def _records(buckets: int, bits: int, hot):
    """Per slice and bucket a row of records; runs that repeat one of the slice as a whole leave as spans
    (negative bucket) at once. Runs of hot minimizers are split into their windows."""

    def go(batches):
        known = np.unpackbits(hot.value).astype(bool)
        for part in slices(batches, limit=3 << 19):
            data, places = utf8(part.column(1))
            doc, start, size, key, content, again = runs(data, places)
            r = np.zeros(len(doc), PLACED)
            ids, base = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
            for name, values in zip(PLACED.names, (key, content, ids[doc], start + base[doc], size, again, start + places[doc])):
                r[name] = values
            r, first = _first_of(r)
            later = [r[_later(r, first)]]
            r = r[np.unique(first)]
            split = known[_cell(r["key"], bits)]
            if split.any():
                windows, first = _first_of(_split(r[split], data))
                later.append(windows[_later(windows, first)])
                r = np.concatenate([r[~split], windows[np.unique(first)]])
            later = np.concatenate(later)
            rows = [(-1 - d % buckets, d, b, None) for d, b in _spans(later["doc"], later["start"], later["size"])]
            bucket = ((r["key"] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((r["start"], r["doc"], bucket))
            r, bucket = r[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            # columns, not rows, as they shrink better
            rows += [(int(bucket[a]), None, b"".join(np.ascontiguousarray(r[f][a:b]).tobytes() for f in RECORD.names), None) for a, b in zip(at, [*at[1:], len(r)])]
            if rows:
                yield _batch(rows, *_TAGGED)

    return go


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // RECORD.itemsize
    out, at = np.zeros(n, RECORD), 0
    for f in RECORD.names:
        width = RECORD[f].itemsize * n
        out[f] = np.frombuffer(blob[at : at + width], RECORD[f])
        at += width
    return out


def _buckets(batches, *columns):
    """Rows sorted by bucket, a list of rows of the given columns per bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, *row in zip(batch.column(0).to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(row)
    if held:
        yield bucket, held


def _decide(batches):
    """Per bucket: spans of runs that repeat an earlier run as a whole, and requests (bucket as it is) for the bytes of the
    first of each kind where a minimizer has several kinds or a run may repeat itself."""
    for bucket, blobs in _buckets(batches, 2, 1):
        if bucket < 0:
            yield _batch([(-1, d, b, None) for b, d in blobs], *_TAGGED)
            continue
        r, first = _first_of(np.concatenate([_unpack(b) for b, _ in blobs]))
        later = _later(r, first)
        rows = [(-1, d, b, None) for d, b in _spans(r["doc"][later], r["start"][later], r["size"][later])]
        kinds = r[np.unique(first)]
        _, of_key, count = np.unique(kinds["key"], return_inverse=True, return_counts=True)
        asked = kinds[(count[of_key] > 1) | kinds["again"]]
        asked = asked[np.argsort(asked["doc"], kind="stable")]
        at = np.flatnonzero(np.diff(asked["doc"], prepend=asked["doc"][0] - 1)) if len(asked) else []
        for a, b in zip(at, [*at[1:], len(asked)]):
            piece = np.zeros(b - a, PIECE)
            for f in PIECE.names:
                piece[f] = asked[f][a:b]
            rows.append((bucket, int(asked["doc"][a]), piece.tobytes(), None))
        if rows:
            yield _batch(rows, *_TAGGED)


def _own(spans: np.ndarray, start: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of a doc_id's spans that belong to the text with this base, and where they start in it."""
    mine = (start >> PLACE_BITS) == (base >> PLACE_BITS)
    return spans[mine], start[mine] - base


def _fetch(batches):
    """Rows (doc, text, base, requests): per bucket the runs with their bytes."""
    for part in slices(batches):
        data, places = utf8(part.column(1))
        by: dict[int, tuple[list, list]] = {}
        for k, (base, asked) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
            for ask in asked:
                piece = np.frombuffer(ask["blob"], PIECE)
                piece, start = _own(piece, piece["start"], base)
                if not len(piece):
                    continue
                blobs, texts = by.setdefault(ask["bucket"], ([], []))
                blobs.append(piece.tobytes())
                texts += [data[a : a + s].tobytes() for a, s in zip((places[k] + start).tolist(), (piece["size"].astype(np.int64) + WINDOW - 1).tolist())]
        rows = [(b, None, b"".join(x), b"".join(t)) for b, (x, t) in by.items()]
        if rows:
            yield _batch(rows, *_TAGGED)


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def shard_transform(symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard and its Burrows-Wheeler transform: the symbol before each suffix, in that order.

    symbols: rank of the four bytes at each place; strings are circles of the given lengths, which are multiples of SYMBOL.
    Ranks are refined by several at once until all differ.
    """
    n = len(symbols)
    base = np.repeat(start, length)
    place = np.arange(n) - base
    ring = np.repeat(length, length)
    _, rank = np.unique(symbols, return_inverse=True)
    reach = SYMBOL
    while True:
        bits = max(1, int(rank.max()).bit_length())
        take = max(2, 63 // bits)
        key = rank.astype(np.uint64)
        for k in range(1, take):
            key = (key << np.uint64(bits)) | rank[base + (place + k * reach) % ring].astype(np.uint64)
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        reach *= take
        if new.all() or reach >= 2 * int(length.max()):
            break
    order = np.argsort(rank, kind="stable")
    return order, symbols[(base + (place - SYMBOL) % ring)[order]]


def _deal(symbols: np.ndarray) -> np.ndarray:
    """Stable order by symbol, by radix."""
    if symbols.dtype == np.uint16:
        return np.argsort(symbols, kind="stable")
    low = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((symbols >> 16).astype(np.uint16)[low], kind="stable")]


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes (shard numbers in merged order), and for each place the number of its interval of
    suffixes that share at least rounds * SYMBOL bytes.

    Once the interleave stays as it is, its dealing order stays too and only boundaries are refined.
    """
    interleave = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    interval, order, steady = np.zeros(len(interleave), np.int32), None, False
    for _ in range(rounds):
        if not steady:
            symbol = np.empty(len(interleave), transforms[0].dtype)
            for k, t in enumerate(transforms):
                symbol[interleave == k] = t
            order = _deal(symbol)
            dealt = interleave[order]
            steady = bool((dealt == interleave).all())
            interleave, sorted_symbol = dealt, symbol[order]
            edge = np.ones(len(order), bool)
            edge[1:] = sorted_symbol[1:] != sorted_symbol[:-1]
        before = interval[order]
        new = edge.copy()
        new[1:] |= before[1:] != before[:-1]
        interval = np.cumsum(new, dtype=np.int32) - 1
    return interleave, interval


def repeated_windows(data: np.ndarray, start: np.ndarray, length: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) sorted by interval, and interval numbers, of windows that share their bytes with another one.

    Strings lie end to end in data. They are dealt to shards in turn; each is padded to a circle with at least one symbol that
    no byte has.
    """
    ring = (length // SYMBOL + 1) * SYMBOL
    where, parts = [], []
    padded = np.zeros(int(ring.sum()), np.uint64)
    begin = np.cumsum(ring) - ring
    padded[_expand(begin, length)] = data[_expand(start, length)].astype(np.uint64) + np.uint64(1)
    base, place, size = np.repeat(begin, ring), _expand(np.zeros_like(ring), ring), np.repeat(ring, ring)
    symbol = np.zeros(len(padded), np.uint64)
    for k in range(SYMBOL):
        symbol = (symbol << np.uint64(9)) | padded[base + (place + k) % size]
    _, rank = np.unique(symbol, return_inverse=True)
    rank = rank.astype(np.uint16 if rank.max() < 65536 else np.uint32)
    for k in range(min(shards, len(start))):
        some = np.arange(k, len(start), shards)
        at = _expand(begin[some], ring[some])
        order, transform = shard_transform(rank[at], np.cumsum(ring[some]) - ring[some], ring[some])
        where.append(at[order])
        parts.append(transform)
    interleave, interval = merge_transforms(parts, WINDOW // SYMBOL)
    suffix = np.empty(len(interleave), np.int64)
    for k, at in enumerate(where):
        suffix[interleave == k] = at
    string = np.repeat(np.arange(len(start)), ring)[suffix]
    offset = suffix - begin[string]
    window = offset <= length[string] - WINDOW
    string, offset, interval = string[window], offset[window], interval[window]
    many = np.bincount(interval)[interval] > 1
    return np.stack([string[many], offset[many]], 1), interval[many]


def _twice(piece: np.ndarray, data: np.ndarray, start: np.ndarray):
    """Trim runs to windows whose hash occurs twice under one minimizer: key, doc, start, bytes' place and size of what is left."""
    total, inverse = _powers(data)
    size = piece["size"].astype(np.int64)
    at = _expand(start, size)
    own = np.repeat(np.arange(len(piece)), size)
    h = mix((total[at + WINDOW] - total[at]) * inverse[at] ^ piece["key"][own])
    order = np.argsort(h)
    s = h[order]
    twice = np.zeros(len(s), bool)
    twice[1:] |= s[1:] == s[:-1]
    twice[:-1] |= s[1:] == s[:-1]
    kept = np.zeros(len(s), bool)
    kept[order] = twice
    new = kept.copy()
    new[1:] &= ~kept[:-1] | (own[1:] != own[:-1])
    edge = np.flatnonzero(new)
    last = kept.copy()
    last[:-1] &= ~kept[1:] | (own[1:] != own[:-1])
    width = np.flatnonzero(last) - edge + 1
    who = own[edge]
    return piece["key"][who], piece["doc"][who], piece["start"][who].astype(np.int64) + at[edge] - start[who], at[edge], width


def _merge_bucket(piece: np.ndarray, data: np.ndarray):
    """Removed runs of windows (doc, start, windows) of a bucket's runs; bytes lie end to end in data."""
    size = piece["size"].astype(np.int64) + WINDOW - 1
    key, doc, start, at, width = _twice(piece, data, np.cumsum(size) - size)
    order = np.lexsort((start, doc, width, key))
    key, doc, start, at, width = key[order], doc[order], start[order], at[order], width[order]
    out = []
    seen: dict[bytes, int] = {}
    first, cut, filled, last = [], [0], 0, None
    for k, (x, a, w) in enumerate(zip(key.tolist(), at.tolist(), width.tolist())):
        if x != last:
            if filled >= MERGE:
                cut.append(len(first))
                filled = 0
            seen, last = {}, x
        text = data[a : a + w + WINDOW - 1].tobytes()
        j = seen.setdefault(text, k)
        if j == k:
            first.append(k)
            filled += len(text)
        elif (doc[k], start[k]) > (doc[j], start[j]):
            out.append((doc[k], start[k], w))
    cut.append(len(first))
    first = np.array(first, np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        some = first[a:b]
        if not len(some):
            continue
        length = width[some] + WINDOW - 1
        found, interval = repeated_windows(data, at[some], length)
        if not len(found):
            continue
        d, s = doc[some][found[:, 0]], start[some][found[:, 0]] + found[:, 1]
        order = np.lexsort((s, d, interval))
        d, s, interval = d[order], s[order], interval[order]
        new = np.ones(len(interval), bool)
        new[1:] = interval[1:] != interval[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (d > d[lead]) | ((d == d[lead]) & (s > s[lead]))
        d, s = d[later], s[later]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
        edge = np.flatnonzero(new)
        ends = s[np.append(edge[1:] - 1, len(s) - 1)] if len(edge) else s
        out += list(zip(d[edge], s[edge], ends - s[edge] + 1))
    return out


def _by_keys(piece: np.ndarray, data: np.ndarray):
    """A bucket's runs with their bytes in parts of about MERGE_BYTES, all runs of a key in one part."""
    size = piece["size"].astype(np.int64) + WINDOW - 1
    start, order = np.cumsum(size) - size, np.argsort(piece["key"], kind="stable")
    key = piece["key"][order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    before = np.append(0, np.cumsum(size[order]))[edge]  # bytes of the keys before
    cut = edge[np.flatnonzero(np.diff(before // MERGE_BYTES, prepend=-1))]
    for a, b in zip(cut, [*cut[1:], len(order)]):
        some = order[a:b]
        yield piece[some], data[_expand(start[some], size[some])]


def _merge(batches):
    for _, rows in _buckets(batches, 2, 3):
        piece, data = np.concatenate([np.frombuffer(b, PIECE) for b, _ in rows]), np.frombuffer(b"".join(t for _, t in rows), np.uint8)
        rows.clear()  # their bytes are in data
        out = [span for part in _by_keys(piece, data) for span in _merge_bucket(*part)]
        if out:
            doc, start, size = (np.array(x, np.int64) for x in zip(*out))
            yield _batch([(-1, d, b, None) for d, b in _spans(doc, start, size)], *_TAGGED)


def _kept(data: np.ndarray, base: int, blobs) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of maximal removed runs."""
    change = np.zeros(len(data) + 1, np.int32)
    for blob in blobs or ():
        span = np.frombuffer(blob, np.int64).reshape(-1, 2)
        span, start = _own(span, span[:, 0], base)
        np.add.at(change, start, 1)
        np.add.at(change, np.minimum(start + span[:, 1] + WINDOW - 1, len(data)), -1)
    gone = np.cumsum(change[:-1]) > 0
    return ~gone, int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))) if len(gone) else 0


def _base(text: str) -> Column:
    """What is added to the places of a text, so that several texts of one doc_id stand one after another: 31 bits of its hash."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)), PLACE_BITS)


#: Bytes of text a bucket on average: a task holds one bucket at a time, whatever the number of partitions.
BUCKET_BYTES = 16 << 20


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, blobs): per document the runs of windows that also start earlier, by pairs of first byte (with _base) and windows."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _base("text").alias("base"))
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits, hot = hot_cells(texts, n_bytes)
    records = texts.mapInArrow(_records(max(4 * parts, -(-n_bytes // BUCKET_BYTES)), bits, spark.sparkContext.broadcast(hot)), TAGGED)
    asked = records.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_decide, TAGGED)
    asked = written(asked, "requests")
    grouped = asked.where("bucket >= 0").groupBy("doc").agg(F.collect_list(F.struct("bucket", "blob")).alias("asked"))  # of one document
    fetched = texts.join(grouped, texts["doc_id"] == grouped["doc"]).select("doc_id", "text", "base", "asked").mapInArrow(_fetch, TAGGED)
    merged = fetched.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge, TAGGED)
    spans = asked.where("bucket < 0").unionByName(merged)
    return spans.groupBy("doc").agg(F.collect_list("blob").alias("blobs")).withColumnRenamed("doc", "doc_id")


def dedup(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes).

    Null and empty texts have no bytes. Texts of fewer than 100 bytes lose none. Equal rows are one document. Several texts of one
    doc_id are documents one after another, in the order of their hashes. Rows without an id are kept whole and repeat nothing.
    Other columns aren't read.
    """

    def go(batches):
        for part in slices(batches):
            data, places = utf8(part.column(1))
            rows = []
            for k, (base, blobs) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                text = data[places[k] : places[k + 1]]
                if blobs:
                    stay, n = _kept(text, base, blobs)
                    rest = text[stay]
                else:
                    rest, n = text, 0
                rows.append((len(text), len(text) - len(rest), n, hashlib.sha256(rest.tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _base("text").alias("base"))
    return texts.join(removed(docs), "doc_id", "left").select("doc_id", "text", "base", "blobs").mapInArrow(go, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns as they were but the text, of which the remaining bytes are left. Bytes of a character that lost others
    go too, as a text must be UTF-8; a text that loses all is empty, a null one stays null."""
    place = docs.columns.index(text)

    def go(batches):
        for part in slices(batches, place):
            data, places = utf8(part.column(place))
            null = part.column(place).is_null().to_pylist()
            new = []
            last = part.num_columns - 1
            for k, (base, blobs) in enumerate(zip(part.column(last - 1).to_pylist(), part.column(last).to_pylist())):
                own = data[places[k] : places[k + 1]]
                new.append(None if null[k] else (own[_kept(own, base, blobs)[0]] if blobs else own).tobytes().decode("utf-8", "ignore"))
            columns = part.columns[:-2]
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-2])

    names = [f"_{k}_{uuid.uuid4().hex}" for k in range(3)]  # whatever the columns of docs are called
    gone = removed(docs).toDF(names[0], names[2])
    joined = docs.withColumn(names[1], _base(text)).join(gone, docs["doc_id"] == F.col(names[0]), "left")
    return joined.select(*(docs[c] for c in docs.columns), names[1], names[2]).mapInArrow(go, docs.schema)
