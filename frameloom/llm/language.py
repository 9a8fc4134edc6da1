"""Language identification: a linear-chain conditional random field labels the words of code-switched text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import fold, slices, trim, utf8
from frameloom.llm.grams import gram_pairs, gram_sums, spaced, word_hashes, words

PARTS, HELD = 4, 2
#: N-grams include the space on either side of a word, so those at its ends are its affixes.
SIZES, BUCKETS, LEXICON = (2, 3, 4), 1 << 16, 1 << 16
#: Words of a segment; segments of a text are scored side by side and linked by their transfer matrices.
SEGMENT = 64
#: Training documents of each language, and their characters, at most; languages at most.
PER_LANGUAGE, MAX_CHARS, MAX_LANGUAGES = 120, 4000, 200
_LETTER = regex.compile(r"\p{L}")


class Model:
    def __init__(self, languages: list[str], grams: np.ndarray, lexicon: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.languages, self.grams, self.lexicon, self.transitions, self.start = languages, grams, lexicon, transitions, start

    def emissions(self, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log potentials of each word; equal words of a slice are looked at once."""
        h = word_hashes(text, first, end)
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        return (gram_sums(text, first[at], end[at], self.grams, SIZES) + self.lexicon[(h[at] % np.uint64(LEXICON)).astype(np.int64)])[back]

    def shares(self, emissions: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Per text the mean of its words' marginal probabilities, by forward-backward over the whole text."""
        n = len(self.languages)
        count = np.bincount(row, minlength=rows)
        segments = -(-count // SEGMENT)
        base, begin = np.cumsum(segments) - segments, np.cumsum(count) - count
        place = np.arange(len(row)) - begin[row]
        total = int(segments.sum())
        potentials = np.ones((SEGMENT, total, n), np.float32)
        real = np.zeros((SEGMENT, total), bool)
        at, seg = place % SEGMENT, base[row] + place // SEGMENT
        potentials[at, seg] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        real[at, seg] = True
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        transfer = np.broadcast_to(np.eye(n, dtype=np.float32), (total, n, n)).copy()
        opening = np.zeros(total, bool)
        opening[base[count > 0]] = True
        for t in range(SEGMENT):
            new = (transfer @ step if t else np.where(opening[:, None, None], transfer, transfer @ step)) * potentials[t][:, None, :]
            new /= new.sum(axis=(1, 2), keepdims=True)
            transfer = np.where(real[t][:, None, None], new, transfer)
        before, behind = np.ones((total, n), np.float32), np.ones((total, n), np.float32)
        begun = np.exp(self.start - self.start.max()).astype(np.float32)
        order = np.argsort(-segments, kind="stable")
        for k in range(int(segments.max(initial=0))):
            live = order[: np.searchsorted(-segments[order], -k, "left")]
            left = begun if k == 0 else np.einsum("ri,rij->rj", before[base[live] + k - 1], transfer[base[live] + k - 1])
            before[base[live] + k] = left / left.sum(axis=-1, keepdims=True)
            if k:
                s = base[live] + segments[live] - 1 - k
                right = np.einsum("rij,rj->ri", transfer[s + 1], behind[s + 1])
                behind[s] = right / right.sum(axis=-1, keepdims=True)
        forward = np.empty_like(potentials)
        now = before
        for t in range(SEGMENT):
            new = (now @ step if t else np.where(opening[:, None], now, now @ step)) * potentials[t]
            new /= new.sum(axis=1, keepdims=True)
            now = forward[t] = np.where(real[t][:, None], new, now)
        marginals, back = np.zeros((total, n), np.float64), behind
        for t in range(SEGMENT - 1, -1, -1):
            both = forward[t] * back
            marginals += np.where(real[t][:, None], both / both.sum(axis=1, keepdims=True), 0)
            new = (potentials[t] * back) @ step.T
            new /= new.sum(axis=1, keepdims=True)
            back = np.where(real[t][:, None], new, back)
        out = np.zeros((rows, n))
        some = np.flatnonzero(count)
        if len(some):
            out[some] = np.add.reduceat(marginals, base[some], axis=0) / count[some, None]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        text, starts = spaced(*utf8(column))
        first, end, row = words(text, starts)
        shares = self.shares(self.emissions(text, first, end), row, len(column)) if len(first) and self.languages else np.zeros((len(column), max(1, len(self.languages))))
        best, score = shares.argmax(axis=1), np.clip(shares.max(axis=1), 0, 1)
        letters = np.array([bool(t) and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
        known = letters & bool(self.languages)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, score, 0.0)


def train(sample: list[tuple[str, str]], steps: int = 40, rate: float = 0.3, seed: int = 5) -> Model:
    """Fit weights and transitions by the likelihood of word labels in code-switched sequences.

    The sequences are made of runs of words from texts of the sample, of either language in turn, so that changes of language
    are seen too. No sample gives a model that says und.
    """
    languages = sorted({y for _, y in sample})
    n = len(languages)
    if not n:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros((LEXICON, 1), np.float32), np.zeros((1, 1)), np.zeros(1))
    text, starts = spaced(*utf8(pa.array([t for t, _ in sample], pa.large_string())))
    first, end, row = words(text, starts)
    h = word_hashes(text, first, end)
    _, at, word = np.unique(h, return_index=True, return_inverse=True)
    label = np.array([languages.index(y) for _, y in sample], np.int64)[row]
    rng = np.random.default_rng(seed)
    # cut every text into runs of 4 to 40 words, shuffle the runs, and string them up again
    cuts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (rng.random(len(row)) < 1 / 16))
    runs = np.split(np.arange(len(row)), cuts[1:]) if len(row) else []
    order = np.concatenate([runs[i] for i in rng.permutation(len(runs))]) if runs else np.zeros(0, np.int64)
    width = min(SEGMENT, max(1, len(order)))
    order = order[: len(order) // width * width].reshape(-1, width)
    w, y = word[order], label[order]
    of_word, bucket = gram_pairs(text, first[at], end[at], BUCKETS, SIZES)
    size = np.maximum(np.bincount(of_word, minlength=len(at)), 1).astype(np.float32)
    slot = (h[at] % np.uint64(LEXICON)).astype(np.int64)
    by_word, by_bucket = np.argsort(of_word, kind="stable"), np.argsort(bucket, kind="stable")
    word_runs, bucket_runs = np.flatnonzero(np.diff(of_word[by_word], prepend=-1)), np.flatnonzero(np.diff(bucket[by_bucket].astype(np.int64), prepend=-1))
    has, held = of_word[by_word][word_runs], bucket[by_bucket][bucket_runs]
    seen = np.bincount(w.ravel(), minlength=len(at))
    common = (np.bincount(slot, seen, minlength=LEXICON) >= 5).astype(np.float32)[:, None]
    grams, lexicon = np.zeros((BUCKETS, n), np.float32), np.zeros((LEXICON, n), np.float32)
    transitions, start = np.zeros((n, n), np.float32), np.zeros(n, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (grams, lexicon, transitions, start)]
    one = np.eye(n, dtype=np.float32)
    for turn in range(1, steps + 1):
        scores = np.zeros((len(at), n), np.float32)
        scores[has] = np.add.reduceat(grams[bucket[by_word]], word_runs, axis=0)
        scores = scores / size[:, None] + lexicon[slot]
        e = np.exp(scores - scores.max(axis=1, keepdims=True))[w]  # sequences, places, labels
        a = np.exp(transitions)
        forward, back = np.empty_like(e), np.ones_like(e)
        now = np.exp(start) * e[:, 0]
        for t in range(width):
            now = now if t == 0 else (now @ a) * e[:, t]
            now = forward[:, t] = now / now.sum(axis=1, keepdims=True)
        g_transitions = np.zeros_like(transitions)
        for t in range(width - 2, -1, -1):
            right = e[:, t + 1] * back[:, t + 1]
            pair = forward[:, t, :, None] * a * right[:, None, :]
            g_transitions += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = right @ a.T
            back[:, t] = b / b.sum(axis=1, keepdims=True)
        np.add.at(g_transitions, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        p = forward * back
        error = p / p.sum(axis=2, keepdims=True) - one[y]
        g_words = np.stack([np.bincount(w.ravel(), error[..., k].ravel(), minlength=len(at)) for k in range(n)], 1).astype(np.float32)
        g_grams, g_lexicon = np.zeros_like(grams), np.zeros_like(lexicon)
        g_grams[held] = np.add.reduceat((g_words / size[:, None])[of_word[by_bucket]], bucket_runs, axis=0)
        np.add.at(g_lexicon, slot, g_words)
        g_start = error[:, 0].sum(axis=0)
        for value, g, (m, v) in zip((grams, lexicon, transitions, start), (g_grams, g_lexicon * common, g_transitions, g_start), state):
            g = g / order.size
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7) + rate * 0.02 * value
    return Model(languages, grams, lexicon, transitions, start)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from at most per_language documents of each language, none of the held-out fold, those of smallest id hash."""
    known = docs.select("doc_id", "lang", F.length("text").alias("n")).where(F.col("lang").isNotNull() & F.col("n").between(1, MAX_CHARS) & (fold("doc_id", PARTS) != HELD))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).orderBy("k", "lang").limit(per_language * MAX_LANGUAGES).select("doc_id", "lang")
    # per_language * MAX_LANGUAGES small rows at most
    rows = docs.select("doc_id", "text", "lang").where(F.length("text").between(1, MAX_CHARS)).join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).collect()
    model = train(sorted((r["text"], r["lang"]) for r in rows))
    trim()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    lang_pred is the language with the largest mean marginal over the text's words, and score that mean. A text that is null or
    has no letter is und with score 0. Repeated rows stay, null ids pass through; lang, source and other columns aren't read.
    A narrow map; the model (some MB, by the number of languages) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for part in slices(batches, limit=2 << 20):
            names, score = own.predict(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (fold("doc_id", PARTS) == HELD).alias("held_out"), "lang_pred", "score")
