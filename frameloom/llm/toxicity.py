"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import fold, labelled_sample, slices, trim, utf8
from frameloom.llm.grams import gram_pairs, mix, spaced, word_hashes, words

#: A text's embeddings are averaged over so many words at least, so that one odd word is no verdict.
LEAST_WORDS = 8
BUCKETS, WIDTH = 1 << 20, 8
#: N-grams of fewer training texts than this learn nothing: they would only recall their texts. The same for a sample of any size.
LEAST_TEXTS = 4
#: Standard errors by which an n-gram must stand in a larger share of the toxic texts of a sample than of the clean ones to learn. The
#: others, tens of thousands beside some hundreds, would let the average learn its texts by heart.
SIGNIFICANT = 4.5
#: What averages are multiplied by before the softmax: the words that matter are a few in a hundred.
GAIN = 30.0
PER_CLASS = 800
#: Bytes of training text of a class at most, whatever a single text's length; texts are scored whole.
CLASS_BYTES = 2_400_000
PARTS, HELD = 5, 0


def _unrepeated(text, first, end, row):
    """Words other than those that repeat the word before them, and their hashes."""
    h = word_hashes(text, first, end)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return first[new], end[new], row[new], h[new]


def _spread_sums(values: np.ndarray, groups: np.ndarray, n: int, item: np.ndarray | None = None, rows: int = 1 << 19) -> np.ndarray:
    """Sums of the rows of values (of values[item]) by sorted group numbers, about `rows` at a time; groups without rows have zeros."""
    out = np.zeros((n, *values.shape[1:]), np.float32)
    begin = np.flatnonzero(np.diff(groups, prepend=-1))
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + rows)))
        low, high = begin[at], begin[stop] if stop < len(begin) else len(groups)
        part = values[low:high] if item is None else values[item[low:high]]
        out[groups[begin[at:stop]]] = np.add.reduceat(part, begin[at:stop] - low, axis=0)
        at = stop
    return out


def _grams(text, first, end, h, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the words and of each word as a whole, sorted by word; some words at a time."""
    owners, buckets = [], []
    for at in range(0, len(h), step):
        own, bucket = gram_pairs(text, first[at : at + step], end[at : at + step], BUCKETS)
        whole = _whole(h[at : at + step])
        own, bucket = np.concatenate([own, np.arange(len(whole))]), np.concatenate([bucket.astype(np.int32), whole.astype(np.int32)])
        order = np.argsort(own, kind="stable")
        owners.append((own[order] + at).astype(np.int32))
        buckets.append(bucket[order])
    return np.concatenate(owners), np.concatenate(buckets)


def _whole(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(77)) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def _texts_of_buckets(row, word, labels: np.ndarray, of_word, bucket, words_known: int) -> np.ndarray:
    """In how many texts of each label each bucket occurs, a text at a time."""
    spread = np.zeros((2, BUCKETS), np.int32)
    of_text, begin = np.searchsorted(row, np.arange(len(labels) + 1)), np.searchsorted(of_word, np.arange(words_known + 1))
    for a, b, label in zip(of_text[:-1], of_text[1:], labels):
        own = np.unique(word[a:b])
        many = begin[own + 1] - begin[own]
        place = np.arange(int(many.sum())) + np.repeat(begin[own] - (np.cumsum(many) - many), many)
        spread[label, np.unique(bucket[place])] += 1
    return spread


def _significant(spread: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Buckets that occur in a larger share of toxic texts than of clean ones, by SIGNIFICANT standard errors, and in LEAST_TEXTS."""
    clean, toxic = np.bincount(labels, minlength=2)
    share = spread.sum(axis=0) / len(labels)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / clean + 1 / toxic))
    return (spread[1] / toxic - spread[0] / clean >= SIGNIFICANT * error) & (spread.sum(axis=0) >= LEAST_TEXTS)


class Model:
    """weights: the softmax's log odds of each bucket's embedding; bias: its offset."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Probability of label 1 per text; a text without words is scored like an average of nothing, at most 0.5."""
        rows = len(places) - 1
        text, starts = spaced(data, places)
        first, end, row = words(text, starts)
        odds = np.full(rows, min(self.bias, 0.0))
        if len(first):
            first, end, row, h = _unrepeated(text, first, end, row)
            _, at, back = np.unique(h, return_index=True, return_inverse=True)
            total, count = gram_pairs(text, first[at], end[at], BUCKETS, weights=self.weights)
            value = ((total + self.weights[_whole(h[at])]) / (count + 1))[back]
            many = np.bincount(row, minlength=rows)
            mean = np.bincount(row, weights=value, minlength=rows) / np.maximum(many, LEAST_WORDS)
            odds = np.where(many > 0, GAIN * mean + self.bias, odds)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(sample: list[tuple[str, int]], steps: int = 80, rate: float = 0.1, seed: int = 7) -> Model:
    """Adam over averages of embeddings; embeddings and the linear layer learn together.

    A text is the average of its words, a word that of its significant n-grams over the number of all it has. The classes weigh alike.
    With one class, no sample or no significant n-gram, a constant model that says 0 (or the only class) results.
    """
    labels, n = np.array([y for _, y in sample], np.int64), len(sample)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 5.0 if n and labels[0] else -5.0)
    text, starts = spaced(*utf8(pa.array([t for t, _ in sample], pa.large_string())))
    first, end, row = words(text, starts)
    if not len(first):
        return Model(np.zeros(BUCKETS), -5.0)
    first, end, row, h = _unrepeated(text, first, end, row)
    _, at, word = np.unique(h, return_index=True, return_inverse=True)  # equal words share their n-grams
    known = len(at)
    of_word, bucket = _grams(text, first[at], end[at], h[at])
    size = np.bincount(of_word, minlength=known).astype(np.float32)[:, None]
    kept = _significant(_texts_of_buckets(row, word, labels, of_word, bucket, known), labels)[bucket]
    if not kept.any():
        return Model(np.zeros(BUCKETS), -5.0)
    of_word, bucket = of_word[kept], bucket[kept]
    used = np.unique(bucket)
    place_of = np.zeros(BUCKETS, np.int32)
    place_of[used] = np.arange(len(used))
    bucket = place_of[bucket]
    by_bucket = np.argsort(bucket, kind="stable")
    word_of, sorted_bucket = of_word[by_bucket], bucket[by_bucket]
    del by_bucket, kept
    # each text's different words, and the share of its words that each is
    pair, times = np.unique(row * np.int64(known) + word, return_counts=True)
    d_row, d_word = pair // known, pair % known
    share = (GAIN * times / np.maximum(np.bincount(row, minlength=n), LEAST_WORDS)[d_row]).astype(np.float32)[:, None]
    by_word = np.argsort(d_word, kind="stable")
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((len(used), WIDTH)) * 0.01).astype(np.float32)
    layer = (rng.standard_normal((WIDTH, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, layer, bias)]
    balance = np.where(labels == 1, (labels == 0).sum() / (labels == 1).sum(), 1.0).astype(np.float32)
    one = np.eye(2, dtype=np.float32)[labels]
    for step in range(1, steps + 1):
        vectors = _spread_sums(table, of_word, known, bucket) / size
        hidden = _spread_sums(vectors[d_word] * share, d_row, n)
        logits = hidden @ layer + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - one) * (balance / n)[:, None]
        g = error @ layer.T
        g_words = _spread_sums((g[d_row] * share)[by_word], d_word[by_word], known)
        g_table = _spread_sums(g_words / size, sorted_bucket, len(used), word_of)
        for value, gradient, (m, v) in zip((table, layer, bias), (g_table, hidden.T @ error, error.sum(axis=0)), state):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    odds = np.zeros(BUCKETS, np.float32)
    odds[used] = table @ (layer[:, 1] - layer[:, 0])
    return Model(odds, bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from at most per_class rows and CLASS_BYTES of either class, of the folds other than HELD."""
    model = train(labelled_sample(docs, labels, "toxic", PARTS, HELD, per_class, CLASS_BYTES))
    trim()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts and texts without words get the model's offset, at most 0.5. Null ids and repeated rows pass through,
    columns other than doc_id and text aren't read. A narrow map; the model (4 MB) goes to the workers by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(*utf8(part.column(1))), pa.float64())], ["doc_id", "score"])

    scored = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", PARTS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they were, whose text scores below the threshold.

    The score is a map over the same record batches, so nothing is joined or shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    place = docs.columns.index("text")

    def run(batches):
        own = Model(*shared.value)
        for part in slices(batches, place):
            yield part.filter(pa.array(own.scores(*utf8(part.column(place))) < threshold))

    return docs.mapInArrow(run, docs.schema)
