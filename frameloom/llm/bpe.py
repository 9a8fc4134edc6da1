"""Byte-level BPE encoding and decoding over length-bucketed, padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from frameloom.llm.common import slices

NONE = np.int32(2**31 - 1)
#: From so many symbols on, a row is a bucket of its own and merges many pairs of the least rank in a round.
LONG_ROW = 2048
#: Words whose ids are kept in a worker; then the store starts anew.
KEPT_WORDS = 300_000
#: Cells of a padded matrix.
CELLS = 1 << 21


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The lines `base64 rank` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing over numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.to = np.full(1 << self.bits, NONE, np.int32)
        todo, at, self.probes = np.arange(len(keys)), self._home(keys), 1
        values = np.array(to, np.int32)
        while len(todo):
            slot = at[todo]
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = keys[todo[free]]
            placed = self.keys[slot] == keys[todo]
            self.to[slot[placed]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids; NONE where a pair has no token or one side is padding (-1)."""
        shape = left.shape
        keys = (left.ravel().astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.ravel().astype(np.uint32).astype(np.uint64)
        found, slot = np.full(len(keys), NONE, np.int32), self._home(keys)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            seen = self.keys[slot[todo]]
            hit = seen == keys[todo]
            found[todo[hit]] = self.to[slot[todo[hit]]]
            todo = todo[~hit & (seen != np.uint64(2**64 - 1))]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return found.reshape(shape)


class Codec:
    """Encodes and decodes by a rank table, each match of the pattern separately, without special tokens."""

    def __init__(self, raw: bytes, pattern: str):
        # In the regex module's \s are four control characters that Unicode's White_Space lacks.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        ranks = read_ranks(raw)
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.words: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [self.whole.get(w) for w in words]
        rest = [k for k, x in enumerate(out) if x is None]
        for k in rest:
            if not words[k]:
                out[k] = b""
            elif len(words[k]) >= LONG_ROW:
                out[k] = self._long(words[k])
        rest = sorted((k for k in rest if out[k] is None), key=lambda k: len(words[k]))
        at = 0
        while at < len(rest):
            width = 4
            while width < len(words[rest[at]]):
                width *= 2
            stop, most = at, max(1, CELLS // width)
            while stop < len(rest) and stop - at < most and len(words[rest[stop]]) <= width:
                stop += 1
            rows = rest[at:stop]
            for k, ids in zip(rows, self._matrix([words[k] for k in rows], len(words[rows[-1]]))):
                out[k] = ids
            at = stop
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """All rows of a bucket: each round every row merges its leftmost pair of least rank and closes the gap."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[np.arange(width + 1) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out, live = [b""] * n, np.arange(n)
        while True:
            best = ranks.argmin(axis=1)
            low = ranks[np.arange(len(live)), best]
            over = low == NONE
            if over.any():
                for row in np.flatnonzero(over):
                    out[live[row]] = ids[row, : lengths[live[row]]].astype("<u4").tobytes()
                go = ~over
                live, best, low = live[go], best[go], low[go]
                if not len(live):
                    return out
                width = int(lengths[live].max())
                ids, ranks = ids[go, : width + 1], ranks[go, :width]
            here, rows = np.arange(ids.shape[1] - 1), np.arange(len(live))
            after = here > best[:, None]
            ids[rows, best] = low
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            lengths[live] -= 1
            ranks[rows, best] = self.pairs.find(ids[rows, best], ids[rows, best + 1])
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.pairs.find(ids[left, best[left] - 1], ids[left, best[left]])

    def _long(self, word: bytes) -> bytes:
        """A bucket of one long row: a round merges the pairs of the least rank from the left, without overlap, up to the first
        that makes a pair of a lower rank, and closes the gaps. Merging one a round would take the same pairs in the same order."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks):
            low = ranks.min()
            if low == NONE:
                break
            hit = np.flatnonzero(ranks == low)
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)  # pairs of one rank side by side overlap: every other one merges
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            # a pair's neighbours when its turn comes: to the left the token of the pair before, to the right what stands there now
            ends = np.concatenate([[-1], ids, [-1]])
            before, behind = ends[hit], ends[np.minimum(hit + 3, len(ends) - 1)]
            before[1:][np.diff(hit) == 2] = low
            token = np.full(len(hit), low, np.int32)
            lower = np.flatnonzero((self.pairs.find(before.astype(np.int32), token) < low) | (self.pairs.find(token, behind.astype(np.int32)) < low))
            hit = hit[: lower[0] + 1] if len(lower) else hit
            ids[hit] = low
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids = ids[stay]
            at = hit - np.arange(len(hit))  # where the merged tokens stand now
            ranks = ranks[stay[1:]] if len(ids) > 1 else ranks[:0]
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(ids) - 1)]
            ranks[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        new = list({w for words in split for w in words} - self.words.keys())
        self.words.update(zip(new, self.encode_words([w.encode() for w in new])))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text by the rank file at `vocabulary` and decode the ids again.

    Returns a row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, with keep_ids also ids (array of int).
    A null text counts as empty: 0 tokens and the digests of no bytes. Repeated rows stay; null ids pass through; other
    columns are not read. No shuffle: a narrow map over record batches, a few MB of text at a time. The rank file is read
    on the driver and broadcast; a vocabulary of more than 64 MB is refused.
    """
    with open(vocabulary, "rb") as file:
        raw = file.read()
    if len(raw) > 64 << 20:
        raise ValueError(f"a vocabulary of {len(raw)} bytes is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches):
        codec = _codec(shared.value, pattern)
        for part in slices(batches):
            coded = codec.encode([t or "" for t in part.column(1).to_pylist()])
            columns = [
                part.column(0),
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in coded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
