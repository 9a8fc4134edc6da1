"""Quality: positive-unlabelled learning with a non-negative risk, from trusted positives and unlabelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import fold, slices, smallest, texts_of, trim, utf8
from frameloom.llm.grams import spaced, word_hashes, words

PARTS, HELD = 5, 0
#: Rows of trusted positives and of unlabelled text that are learnt from, and their characters, at most.
POSITIVES, UNLABELLED, MAX_CHARS = 2000, 4000, 20_000
PAIRS = 512


def features(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Per text: shares of byte kinds, of repeats among words and lines' words, and hashed byte pairs; texts of any length."""
    rows = len(places) - 1
    size = np.maximum(np.diff(places), 1)[:, None].astype(np.float64)
    row = np.repeat(np.arange(rows), np.diff(places))
    kind = np.zeros(256, np.int64)  # others
    for k, group in enumerate((range(97, 123), range(65, 91), range(48, 58), [32], [10, 13], range(128, 256), [33, 63], [46, 44, 59, 58], [124], [35, 36, 37, 38, 42]), 1):
        kind[list(group)] = k
    kinds = np.bincount(row * 11 + kind[data], minlength=rows * 11).reshape(rows, 11) / size
    pair = np.zeros((rows, PAIRS))
    if len(data) > 1:
        same = row[1:] == row[:-1]
        lower = np.where((data >= 65) & (data < 91), 64, np.where((data >= 48) & (data < 58), 48, data)).astype(np.uint32)
        h = ((lower[:-1] * np.uint32(257) + lower[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(23)
        pair = np.bincount(row[1:][same] * PAIRS + h[same], minlength=rows * PAIRS).reshape(rows, PAIRS) / size
    text, starts = spaced(data, places)
    first, end, owner = words(text, starts)
    count = np.maximum(np.bincount(owner, minlength=rows), 1)
    h = word_hashes(text, first, end)
    key = np.sort((h & np.uint64(2**40 - 1)) | (owner.astype(np.uint64) << np.uint64(40)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=rows) / count
    again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=rows) / count if len(h) else np.zeros(rows)
    length = np.bincount(owner, end - first, minlength=rows) / count
    other = np.stack([distinct, distinct * np.log1p(count) / 8, again, length / 10, np.log1p(size[:, 0]) / 10, kinds[:, 2] / (kinds[:, 1] + kinds[:, 2] + 0.01)], 1)
    return np.concatenate([np.sqrt(kinds), other, np.sqrt(pair)], 1)


class Model:
    def __init__(self, mean, spread, weights, bias, prior):
        self.mean, self.spread, self.weights, self.bias, self.prior = mean, spread, weights, float(bias), prior

    def scores(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((features(data, places) - self.mean) / self.spread @ self.weights + self.bias, -30, 30)))


def _descend(gradient, width: int, steps: int, rate: float, decay: float):
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        g[:-1] += decay * w[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from a classifier of trusted against unlabelled.

    Where only positives are, its probability is n_p / (n_p + prior * n_u). That level is read off at the middle of positives
    that it was not fitted on.
    """
    fitted, kept = positive[::2], positive[1::2]
    x = np.concatenate([fitted, unlabelled])
    y = np.concatenate([np.ones(len(fitted)), np.zeros(len(unlabelled))])
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = _descend(lambda w: x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x), x.shape[1], 150, 0.02, 0.01)
    level = np.median(1 / (1 + np.exp(-(kept @ w[:-1] + w[-1])))) if len(kept) else 0.5
    return float(np.clip(len(fitted) / max(1, len(unlabelled)) * (1 - level) / max(level, 1e-6), 0.1, 0.95))


def train(positive: list[str], unlabelled: list[str], prior: float | None = None, steps: int = 500) -> Model:
    """Logistic loss; where the estimated negative risk falls below zero, its descent is turned round, as the method has it.

    Without positives or unlabelled texts the model says 1 for every text: nothing is known against any.
    """
    if not positive or not unlabelled:
        width = features(*utf8(pa.array([""]))).shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 2.0, 1.0)
    p, u = (features(*utf8(pa.array(x, pa.large_string()))) for x in (positive, unlabelled))
    mean, spread = u.mean(axis=0), u.std(axis=0) + 0.02
    p, u = ((x - mean) / spread for x in (p, u))
    p, u = np.clip(p, -6, 6), np.clip(u, -6, 6)
    prior = estimated_prior(p, u) if prior is None else prior
    p, u = (np.concatenate([x, np.ones((len(x), 1))], 1) for x in (p, u))

    def gradient(w):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        negative = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        return -down if negative < 0 else prior * (p.T @ (sp - 1)) / len(p) + down

    w = _descend(gradient, p.shape[1], steps, 0.01, 0.002)
    return Model(mean, spread, w[:-1], w[-1], prior)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trusted positives: rows with quality 1 outside the held-out fold. Unlabelled: any text outside it. Both are bounded
    samples, of smallest id hash; no label 0 is read."""
    ids = docs.where(F.length("text").between(1, MAX_CHARS) & (fold("doc_id", PARTS) != HELD)).select("doc_id").distinct()
    trusted = smallest(ids.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi"), POSITIVES)
    positive, unlabelled = (sorted(r["text"] for r in texts_of(docs, x, MAX_CHARS).collect()) for x in (trusted, smallest(ids, UNLABELLED, 1)))
    model = train(positive, unlabelled)
    trim()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts are scored as texts without bytes. Repeated rows stay, null ids pass through, other columns aren't
    read. A narrow map; the model (some KB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for part in slices(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(*utf8(part.column(1))), pa.float64())], ["doc_id", "score"])

    scored = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", PARTS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
