"""Approximate nearest neighbours by inner product: an inverted multi-index over two vector halves."""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import shuffle_parts

#: Centroids of each half; the square of it is the number of cells.
CENTROIDS = 128
#: Vectors that the centroids are fitted on, at most.
FIT_ROWS = 8192
#: Cells are visited in order until they hold this share of all different vectors.
SHARE = 0.4
#: Vectors of a bin of cells at most: what a task holds while the queries that visit the bin stream past.
BIN_ROWS = 1024


def _kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(rows))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * rows @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def cells_in_order(query: np.ndarray, left: np.ndarray, right: np.ndarray, held: np.ndarray, need: float) -> list[int]:
    """Multi-sequence traversal: cell numbers by falling sum of the halves' inner products, until they hold `need` vectors.

    A heap holds the pairs of ranks whose predecessors in both directions have been visited.
    """
    half = left.shape[1]
    a, b = left @ query[:half], right @ query[half:]
    order_a, order_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, done, out, got = [(-(a[order_a[0]] + b[order_b[0]]), 0, 0)], {}, [], 0
    while heap and got < need:
        _, i, j = heapq.heappop(heap)
        done[i, j] = True
        cell = int(order_a[i]) * len(b) + int(order_b[j])
        if held[cell]:
            out.append(cell)
            got += held[cell]
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(heap, (-(a[order_a[i + 1]] + b[order_b[j]]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(heap, (-(a[order_a[i]] + b[order_b[j + 1]]), i, j + 1))
    return out


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array of double): rows with an id and a vector that is neither null, empty nor zero and has no null or
    non-finite component. A vec_id with several vectors keeps the smallest."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows


def search(embeddings: DataFrame, every: int = 20, k: int = 20, centroids: int = CENTROIDS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`.

    Vectors of different lengths have no inner product: those of each length are searched among themselves, by an index of their
    own. An empty table gives an empty result. With share 1 every cell is visited, which makes the search exact.
    """
    rows = valid(embeddings)
    lengths = [r[0] for r in rows.select(F.size("vector").alias("d")).distinct().orderBy("d").collect()]
    found = [_search(rows.where(F.size("vector") == d), d, every, k, centroids, share) for d in lengths]
    return functools.reduce(DataFrame.unionByName, found) if found else embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _best(q: np.ndarray, v: np.ndarray, allowed: np.ndarray, ids: list, query: int, k: int) -> list[tuple[float, int]]:
    """The k best (-score, id) of one query among the allowed vectors; only these are multiplied."""
    if len(allowed) > k + 1:
        rough = v[allowed] @ q
        cut = np.partition(rough, -(k + 1))[-(k + 1)]
        allowed = allowed[rough >= cut - 1e-9 * (1 + abs(cut))]
    score = np.zeros(len(allowed))
    for j in range(len(q)):  # one order of summation, whatever the bin
        score += q[j] * v[allowed, j]
    return heapq.nsmallest(k, [(-s, x) for s, row in zip(score.tolist(), allowed) for x in ids[row] if x != query])


def _search(rows: DataFrame, d: int, every: int, k: int, centroids: int, share: float) -> DataFrame:
    """search() of vectors of length d.

    Equal vectors are one entry with their k + 1 smallest ids, as no other copy can be among the k nearest of any query. The
    driver holds the centroids and a count per cell, both bounded by centroids squared. Each entry goes to one bin of at most
    about BIN_ROWS entries (a large cell has several); each query to the bins of the cells it visits. A task holds one bin and
    streams its queries, of which it multiplies each with the entries of its own cells alone.
    """
    spark = rows.sparkSession
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vector").collect()], np.float64)
    half = (d + 1) // 2
    left, right = _kmeans(sample[:, :half], centroids), _kmeans(sample[:, half:], centroids) if d > half else np.zeros((1, 0))
    model = spark.sparkContext.broadcast((left, right))

    def assign(batches):
        a, b = model.value
        for pdf in batches:
            if len(pdf):
                v = _vectors(pdf["vector"])
                x = ((a**2).sum(1)[None] - 2 * v[:, :half] @ a.T).argmin(1)
                y = ((b**2).sum(1)[None] - 2 * v[:, half:] @ b.T).argmin(1)
                yield pd.DataFrame({"vector": [row.tobytes() for row in v], "cell": x * len(b) + y, "ids": pdf["ids"]})

    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    index = entries.mapInPandas(assign, "vector binary, cell long, ids array<long>")
    held = np.zeros(len(left) * len(right), np.int64)
    for cell, n in index.groupBy("cell").count().collect():
        held[cell] = n
    need = max(share * held.sum(), k + 2)  # as few as that are all looked at
    # cells fill bins in turn; a cell of more than BIN_ROWS gets bins of its own
    first, count, used, fill = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, 0
    for cell in np.flatnonzero(held):
        if held[cell] > BIN_ROWS:
            used += fill > 0
            first[cell], count[cell], fill = used, -(-held[cell] // BIN_ROWS), 0
            used += count[cell]
            continue
        if fill + held[cell] > BIN_ROWS:
            used, fill = used + 1, 0
        first[cell], fill = used, fill + held[cell]
    places = spark.sparkContext.broadcast((held, first, count, need))
    table = "bin long, asks boolean, query_id long, vector binary, cells binary, ids array<long>"

    def visit(batches):
        a, b = model.value
        held, first, count, need = places.value
        for pdf in batches:
            out = []
            for vec_id, vector in zip(pdf["vec_id"], pdf["vector"]):
                v = np.asarray(vector, np.float64)
                bins: dict[int, list[int]] = {}
                for cell in cells_in_order(v, a, b, held, need):
                    for at in range(first[cell], first[cell] + count[cell]):
                        bins.setdefault(int(at), []).append(cell)
                out += [(at, True, vec_id, v.tobytes(), np.array(cells, np.int32).tobytes(), None) for at, cells in bins.items()]
            yield pd.DataFrame(out, columns=["bin", "asks", "query_id", "vector", "cells", "ids"])

    def deal(batches):
        _, first, count, _ = places.value
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            salt = np.array([x[0] for x in pdf["ids"]], np.int64) % count[cell] if len(pdf) else cell
            yield pd.DataFrame({"bin": first[cell] + salt, "asks": False, "query_id": 0, "vector": pdf["vector"], "cells": [np.int32(c).tobytes() for c in cell], "ids": pdf["ids"]})

    def rerank(batches):
        """Rows sorted by bin, its entries before the queries that it is asked."""
        n_cells, current, entries, v = len(places.value[0]), None, [], None
        for pdf in batches:
            out = []
            for at, asks, query, vector, cells, ids in zip(pdf["bin"], pdf["asks"], pdf["query_id"], pdf["vector"], pdf["cells"], pdf["ids"]):
                if at != current:
                    current, entries, v = at, [], None
                if not asks:
                    entries.append((vector, cells, [int(x) for x in ids]))
                    continue
                if v is None and entries:
                    v = np.frombuffer(b"".join(x for x, _, _ in entries), np.float64).reshape(-1, d)
                    cell = np.frombuffer(b"".join(x for _, x, _ in entries), np.int32)
                if v is not None:
                    seen = np.zeros(n_cells, bool)
                    seen[np.frombuffer(cells, np.int32)] = True
                    found = _best(np.frombuffer(vector, np.float64), v, np.flatnonzero(seen[cell]), [x for _, _, x in entries], int(query), k)
                    if found:
                        out.append((int(query), [x for _, x in found], [-s for s, _ in found]))
            yield pd.DataFrame(out, columns=["query_id", "vec", "score"])

    # by a hash: Spark leaves out a repartition by the aggregate's own key, and merges the aggregate's small partitions into one task
    asked = rows.where(F.col("vec_id") % every == 0).repartition(shuffle_parts(spark), F.xxhash64("vec_id")).mapInPandas(visit, table)
    dealt = index.mapInPandas(deal, table).unionByName(asked).repartition("bin").sortWithinPartitions("bin", "asks")
    near = dealt.mapInPandas(rerank, "query_id long, vec array<long>, score array<double>")
    return near.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(_merged(k), "query_id long, rank int, vec_id long, score double")


def _merged(k: int):
    """Rows (query_id, vec, score) sorted by query: the k best of each, of which no more than k are held."""

    def rows(query, best):
        return [(query, rank, vec, -score) for rank, (score, vec) in enumerate(best, 1)]

    def run(batches):
        current, best = None, []
        for pdf in batches:
            out = []
            for query, vec, score in zip(pdf["query_id"].tolist(), pdf["vec"], pdf["score"]):
                if query != current:
                    out += rows(current, best)
                    current, best = query, []
                best = heapq.nsmallest(k, [*best, *((-s, int(x)) for x, s in zip(vec, score))])
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
        yield pd.DataFrame(rows(current, best), columns=["query_id", "rank", "vec_id", "score"])

    return run


def exact(embeddings: DataFrame, every: int = 20, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    """Brute force on the driver, for tests and for measuring recall on small tables."""
    rows = valid(embeddings).collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = v @ v[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out
