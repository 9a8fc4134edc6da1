"""N-gram Jaccard join in the metric space of shingle sets, exact, for components of documents linked at 0.8 or more.

1. Equal sets are one point. Points are blocked by signatures: three (small sets: two) neighbours in the order of the hashes.
   Where |x and y| >= 0.8 |x or y|, each element that only one of them has breaks at most three neighbourhoods of x, so the first
   0.6 |x| + 1 of them can't all be broken. Linked points hence share a signature, and stand in one component of the signature graph.
2. Each component but the smallest is split into Voronoi regions of several pivots, recursively. Boundary points are replicated
   to every region whose pivot isn't farther than the nearest by more than 0.4, unless linked to that pivot itself.
3. Within a region the join is done by pivots too: distances to a pivot give its links; the triangle inequality leaves those points
   to look at whose distances to it differ by 0.2 at most; a point all of whose such neighbours are already in its component is done.
   Once pivots tell little, the points left are compared by bounds of their intersections, from the rarer elements they share.
4. A component too large for a task is first parted by its sets' rarest elements, of which linked sets share one. A region that
   doesn't shrink then is dense: its pivots link most of its points. If it is too large for a task, the points outside its main
   component are compared with all others, in pairs of blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import shuffle_parts, slices, trim, written
from frameloom.llm.grams import mix
from frameloom.llm.graph import components
from frameloom.llm.shingles import shingle_sets

#: Two sets are linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
RADIUS = 1 - PERCENT / 100
#: Shingles of a region from which on it is split, those that one task joins at most if it doesn't shrink, and pivots of a split.
REGION_SHINGLES, TASK_SHINGLES, PIVOTS = 1 << 14, 1 << 20, 16
#: Splits in a row, after which what is still too large counts as dense.
LEVELS = 4
#: A region shrinks if none of its parts has more than this share of it, and all of them together not twice of it.
SHRUNK = 0.6
#: Pivots in a row that leave more than IDLE_SHARE of a cluster to look at, after which bounds are used; fewer than FEW points don't need them.
IDLE, IDLE_SHARE, FEW = 4, 7 / 8, 64
#: Elements that more than this share of a cluster has are common; what rarer ones two sets share is counted.
CORE = 1 / 16
#: Sets of up to SMALL elements use pairs of neighbours, sets of more than LARGE triples, those between both.
LARGE, SMALL = 32, 40
_ID = np.uint64(0x9E3779B97F4A7C15)


def _set_id(s: np.ndarray) -> bytes:
    return np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64), mix(s ^ _ID).sum(dtype=np.uint64)], np.uint64).tobytes()


def signatures(s: np.ndarray) -> np.ndarray:
    n, out = len(s), []
    if n > LARGE:
        k = n * 3 // 5 + 1
        out.append(mix(s[:k] * np.uint64(3) + mix(s[1 : k + 1]) * np.uint64(5) + mix(s[2 : k + 2] + np.uint64(9))))
    if 3 < n <= SMALL:  # with fewer only equal sets can be linked
        k = n * 2 // 5 + 1
        out.append(mix(s[:k] * np.uint64(7) + mix(s[1 : k + 1]) * np.uint64(11)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _describe(batches):
    for part in slices(batches):
        sets = shingle_sets(part.column(1))
        ids = [_set_id(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([np.frombuffer(x, np.int64)[0] if x else None for x in ids], pa.int64())], ["doc_id", "n_shingles", "set_id", "key"])


def _sign(buckets: int):
    """Per slice and bucket one row: point keys, how many signatures each has there, and the signatures, five bytes each.

    Points of a slice that share a signature are joined at once (a negative bucket, with the edges of a forest), and only the first
    of them travels with it: of a signature that very many points share, a bucket gets one a slice.
    """

    def run(batches):
        for part in slices(batches):
            points = {_set_id(s): s for s in shingle_sets(part.column(1)) if len(s) > 3}
            if not points:
                continue
            keys = np.array([np.frombuffer(x, np.int64)[0] for x in points], np.int64)
            signed = [signatures(s) for s in points.values()]
            sig = np.concatenate(signed)
            own = np.repeat(np.arange(len(keys)), [len(x) for x in signed])
            order = np.argsort(sig, kind="stable")
            sig, own = sig[order], own[order]
            new = np.append(True, sig[1:] != sig[:-1])
            lead = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
            pairs = np.unique(lead[~new] * len(keys) + own[~new])
            root = _forest(np.stack(np.divmod(pairs, len(keys)), 1), len(keys))
            joined = np.flatnonzero(root != np.arange(len(keys)))
            rows = [(-1 - int(keys[0]) % buckets, keys[joined].tobytes(), keys[root[joined]].tobytes(), b"")] if len(joined) else []
            sig, own = sig[new], own[new]
            bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((own, bucket))
            sig, own, bucket = sig[order], own[order], bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            five = sig.view(np.uint8).reshape(-1, 8)[:, :5]
            for a, b in zip(starts, [*starts[1:], len(sig)]):
                who, count = np.unique(own[a:b], return_counts=True)
                rows.append((int(bucket[a]), keys[who].tobytes(), count.astype(np.uint32).tobytes(), five[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "keys", "counts", "sigs"])
        trim()  # the worker lives on

    return run


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n nodes."""
    parent = list(range(n))
    for a, b in (pair for k in range(0, len(pairs), 1 << 14) for pair in pairs[k : k + (1 << 14)].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
    for i in range(n):  # parents are smaller, so theirs are known
        parent[i] = parent[parent[i]]
    return np.array(parent, np.int64)


def _meet(held: list[tuple[bytes, bytes, bytes]]):
    keys = np.concatenate([np.repeat(np.frombuffer(k, np.int64), np.frombuffer(c, np.uint32)) for k, c, _ in held])
    sig = np.zeros((len(keys), 8), np.uint8)
    sig[:, :5] = np.frombuffer(b"".join(s for *_, s in held), np.uint8).reshape(-1, 5)
    sig = sig.reshape(-1).view(np.uint64)
    order = np.lexsort((keys, sig))
    sig, keys = sig[order], keys[order]
    linked = np.flatnonzero((sig[1:] == sig[:-1]) & (keys[1:] != keys[:-1]))
    nodes, at = np.unique(np.stack([keys[linked], keys[linked + 1]]), return_inverse=True)
    pairs = np.unique(at.reshape(2, -1).T, axis=0)
    root = _forest(pairs, len(nodes))
    some = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["a", "b"])


def _candidates(batches):
    """Rows sorted by bucket: edges of a forest that joins the points of each signature of a bucket; those of slices as they are."""
    bucket, held = None, []
    for batch in batches:
        for b, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b < 0:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row[:2]], ["a", "b"])
                continue
            if b != bucket and held:
                yield _meet(held)
                held = []
            bucket = b
            held.append(row)
    if held:
        yield _meet(held)


class Points:
    """Sets of a region, end to end, their elements numbered densely."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        known, self.element = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(known), np.int32)

    def common(self, p: int, alive: np.ndarray) -> np.ndarray:
        """Intersection sizes of point p with the points alive."""
        own = self.element[self.start[p] : self.start[p] + self.size[p]]
        self.mark[own] = 1
        size = self.size[alive]
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(self.start[alive] - begin, size)
        out = np.add.reduceat(self.mark[self.element[place]], begin)
        self.mark[own] = 0
        return out

    def clusters(self, percent: int) -> list[np.ndarray]:
        """Points parted so that links stay within a part; points without a possible partner are left out.

        Two linked sets share one of the rarest elements of each: those of a set but ceil(percent / 100 of its size) - 1. So what
        very many points share (a common passage) doesn't hold them together if it makes less than percent of their sets.
        """
        n, known, count = len(self.size), len(self.mark), np.bincount(self.element)
        rank, single = np.empty(known, np.int64), int((count == 1).sum())
        rank[np.argsort(count, kind="stable")] = np.arange(known)
        rare, bounds = [], np.unique(np.searchsorted(self.start, np.arange(0, self.start[-1] + 1, 1 << 18)))
        for a, b in zip(bounds, [*bounds[1:], n]):
            size = self.size[a:b]
            begin = np.cumsum(size) - size
            key = np.sort(np.repeat(np.arange(a, b) * known, size) + rank[self.element[self.start[a] : self.start[a] + size.sum()]])
            first = np.arange(len(key)) - np.repeat(begin, size) <= np.repeat(size + -(size * percent) // 100, size)
            rare.append(key[first & (key % known >= single)])  # what only one set has can't be shared
        own, element = np.divmod(np.concatenate(rare), known)
        order = np.argsort(element, kind="stable")
        own, element = own[order], element[order]
        meet = np.flatnonzero(element[1:] == element[:-1])
        root = _forest(np.stack(np.divmod(np.unique(own[meet] * n + own[meet + 1]), n), 1), n)
        order = np.argsort(root, kind="stable")
        return [c for c in np.split(order, np.flatnonzero(np.diff(root[order])) + 1) if len(c) > 1]


def join_region(sets: list[np.ndarray], percent: int = PERCENT, main: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly what all links of the points connect; sets are not empty. Points of main are connected already."""
    points, label = Points(sets), np.arange(len(sets))
    if main is not None and main.any():
        label[main] = np.flatnonzero(main)[0]
    return [link for cluster in points.clusters(percent) for link in _join_cluster(points, cluster, label, percent)]


def _join_cluster(points: Points, cluster: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """join_region for the points of a cluster; label: what is connected already."""
    links, radius, idle = [], 1 - percent / 100, 0
    alive = _connected_last(cluster, label)
    while len(alive) > 1 and (label[alive] != label[alive[0]]).any():
        if idle >= IDLE and len(alive) > FEW:
            return links + _join_bounded(points, alive, label, percent)
        before, p = len(alive), int(alive[0])
        size = points.size[alive]
        lawful = (100 * np.minimum(size, points.size[p]) >= percent * np.maximum(size, points.size[p]))
        common = points.common(p, alive)
        union = size + points.size[p] - common
        near = alive[lawful & (100 * common >= percent * union) & (alive != p)]
        group, at = np.unique(label[np.append(p, near)], return_index=True)
        links += [(p, int(near[k - 1])) for k, g in zip(at, group) if k and g != label[p]]  # one per component that is met
        if len(group) > 1:
            label[cluster[np.isin(label[cluster], group)]] = group[0]
        distance = 1 - common / union
        keep = alive != p
        alive, distance = alive[keep], distance[keep]
        if not len(alive):
            break
        # points all of whose possible partners (distances to p within the radius) share their label have no more to tell
        order = np.sort(distance)
        low, high = distance - radius - 1e-9, distance + radius + 1e-9
        every = np.searchsorted(order, high, "right") - np.searchsorted(order, low, "left")
        _, own = np.unique(label[alive], return_inverse=True)
        key = np.sort(own * 4.0 + distance)
        same = np.searchsorted(key, own * 4.0 + np.minimum(high, 2.0), "right") - np.searchsorted(key, own * 4.0 + np.maximum(low, -1.0), "left")
        alive = alive[every > same]
        idle = idle + 1 if len(alive) > IDLE_SHARE * before else 0
    return links


def _connected_last(some: np.ndarray, label: np.ndarray) -> np.ndarray:
    at, count = np.unique(label[some], return_inverse=True, return_counts=True)[1:]
    return some[np.argsort(count[at], kind="stable")]


def _join_bounded(points: Points, alive: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """_join_cluster for points that pivots don't prune: a point meets only those with which it may share enough.

    The rarer elements that two sets share are counted by postings; of common ones they share at most what the one with fewer has.
    So a point costs a few steps a point and its postings, and not all elements of all sets.
    """
    links, n, size = [], len(alive), points.size[alive]
    begin = np.cumsum(size) - size
    element = points.element[np.arange(int(size.sum())) + np.repeat(points.start[alive] - begin, size)]
    own = np.repeat(np.arange(n), size)
    count = np.bincount(element, minlength=len(points.mark))
    common = count[element] > max(1, n * CORE)
    core = np.bincount(own[common], minlength=n)
    rare = ~common & (count[element] > 1)
    own, element = own[rare], element[rare]
    count = np.bincount(element, minlength=len(points.mark))
    first, posting = np.cumsum(count) - count, own[np.argsort(element, kind="stable")]
    at = np.searchsorted(own, np.arange(n + 1))
    leads = np.argsort(size - core, kind="stable")[:IDLE]  # next to what all share: these connect most
    left, known = np.ones(n, bool), label[alive]

    def meet(k: int) -> None:
        nonlocal known
        left[k] = False
        mine = element[at[k] : at[k + 1]]
        many = count[mine]
        shared = np.bincount(posting[np.arange(int(many.sum())) + np.repeat(first[mine] - (np.cumsum(many) - many), many)], minlength=n)
        other = np.flatnonzero(left & (known != known[k]) & ((shared + np.minimum(core, core[k])) * (100 + percent) >= percent * (size + size[k])))
        if not len(other):
            return
        both = points.common(int(alive[k]), alive[other])
        other = other[100 * both >= percent * (size[other] + size[k] - both)]
        group, one = np.unique(known[other], return_index=True)
        links.extend((int(alive[k]), int(alive[j])) for j in other[one])  # one per component that is met
        if len(group):
            known = np.where(np.isin(known, group), known[k], known)

    for k in leads:
        meet(int(k))
    for k in _connected_last(np.flatnonzero(left), known):
        if not left.any() or (known[left] == known[np.argmax(left)]).all():
            break
        meet(int(k))
    label[alive] = known
    return links


def _view(cell: pa.Scalar):
    return cell.as_buffer()


def _groups(batches, width: int):
    """Runs of equal first columns of sorted record batches, as lists of rows."""
    key, held = None, []
    for batch in batches:
        # binary cells stay where they are in the batch
        for row in zip(*(map(_view, batch.column(i)) if pa.types.is_binary(batch.column(i).type) else batch.column(i).to_pylist() for i in range(width))):
            if row[0] != key and held:
                yield held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield held


def _join_all(batches):
    """Rows (region, rep, tokens, main) sorted by region: links (a, b)."""
    for rows in _groups(batches, 4):
        if len(rows) < 2:
            continue
        links = join_region([np.frombuffer(t, np.uint64) for _, _, t, _ in rows], main=np.array([m for *_, m in rows], bool))
        yield pa.RecordBatch.from_arrays([pa.array([rows[a][1] for a, _ in links], pa.int64()), pa.array([rows[b][1] for _, b in links], pa.int64())], ["a", "b"])


def _tokens(batches):
    for part in slices(batches, column=2):
        sets = shingle_sets(part.column(2))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["region", "rep", "tokens"])


def _assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links to pivots, and the regions that each point goes to; pivots are those of one region."""
    out = []
    pivots = [np.frombuffer(t, np.uint64) for t in right["tokens"]]
    ids = right["rep"].tolist()
    for region, rep, tokens in zip(left["region"], left["rep"], left["tokens"]):
        s = np.frombuffer(tokens, np.uint64)
        common = np.array([len(np.intersect1d(s, p, assume_unique=True)) for p in pivots])
        union = np.array([len(s) + len(p) for p in pivots]) - common
        linked, distance = 100 * common >= PERCENT * union, 1 - common / union
        home = int(distance.argmin())
        out += [(region, rep, b"", ids[j], -1) for j in np.flatnonzero(linked) if ids[j] != rep]
        out += [(region, rep, tokens, 0, j) for j in range(len(pivots)) if j == home or (not linked[j] and distance[j] <= distance[home] + 2 * RADIUS + 1e-9)]
    return pd.DataFrame(out, columns=["region", "rep", "tokens", "pivot", "part"])


def _near_pivots(points: DataFrame, chosen: DataFrame, big: DataFrame, limit: int) -> DataFrame:
    """_assign of all points of the regions of big (region, total) against the chosen pivots, in salted groups of about limit shingles."""
    salts = big.select("region", F.ceil(F.col("total") / limit).cast("long").alias("salts"))
    parts = points.join(salts, "region").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    pivots = written(chosen.join(salts, "region").select("region", "rep", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")), "pivots")
    went = parts.select("region", "salt", "rep", "tokens").groupBy("region", "salt").cogroup(pivots.groupBy("region", "salt"))
    return written(went.applyInPandas(_assign, "region long, rep long, tokens binary, pivot long, part int"), "voronoi")


def _size(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.sum(F.octet_length("tokens") / 8).alias("total"), F.count("*").alias("n"))


def _hashed_first(points: DataFrame, seed: int) -> DataFrame:
    """points with k, their number in the order of a hash in their region (a region's first ones, so that a task keeps few)."""
    return points.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("rep", F.lit(seed)), "rep")))


def _elements(batches):
    for batch in batches:
        region, rep = (batch.column(k).to_numpy() for k in range(2))
        size = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) // 8
        places = np.append(0, np.cumsum(size))
        sets = [np.frombuffer(cell.as_buffer(), np.int64) for cell in batch.column(2)]
        bounds = np.unique(np.searchsorted(places, np.arange(0, places[-1] + ELEMENT_ROWS, ELEMENT_ROWS), "right") - 1)
        for i, j in zip(bounds[:-1], bounds[1:]):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x[i:j], size[i:j])) for x in (region, rep, size)] + [pa.array(np.concatenate(sets[i:j]))], ["region", "rep", "size", "element"])


#: Elements that travel as a batch, about.
ELEMENT_ROWS = 1 << 16


def _by_rarest(points: DataFrame) -> DataFrame:
    """Regions parted so that links stay within a part, as Points.clusters does; points without a possible partner are left out."""
    each = points.mapInArrow(_elements, "region long, rep long, size long, element long")
    known = each.groupBy("region", "element").agg(F.count("*").alias("n")).where("n > 1")  # what only one set has can't be shared
    mine = each.join(known, ["region", "element"]).groupBy("region", "rep", "size").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("elements"))
    single = F.col("size") - F.size("elements")
    asked = F.greatest(F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1 - single, F.lit(0)).cast("int")
    rare = mine.select("region", "rep", F.explode(F.slice("elements", 1, asked)["element"]).alias("element"))
    least = F.min("rep").over(Window.partitionBy("region", "element"))
    found = components(rare.select(F.col("rep").alias("a"), least.alias("b")))
    return points.join(found, points["rep"] == found["node"]).select(F.xxhash64("region", "component", F.lit("rarest")).alias("region"), "rep", "tokens")


def _dense(points: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """Blocks (region, rep, tokens, main) of about limit shingles of regions that pivots don't part.

    The pairs within a region's main component need no look. Its other points, few where pivots have linked most, and the main ones
    are dealt to chunks of half a block; every two chunks of which one isn't main are a block, so that the largest region is many
    tasks' and no task holds more than a block.
    """
    found = components(links)
    named = points.join(found, points["rep"] == found["node"], "left").select("region", "rep", "tokens", F.coalesce("component", "rep").alias("label"))
    largest = named.groupBy("region", "label").count().groupBy("region").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    named = written(named.join(largest, "region").withColumn("main", F.col("label") == F.col("largest")).drop("label", "largest"), "named")
    total, rest = (F.sum(F.when(x, F.octet_length("tokens") / 8).otherwise(0)) for x in (F.col("main"), ~F.col("main")))
    chunks = lambda n: F.ceil(2 * n / limit).cast("long")
    dealt = named.join(named.groupBy("region").agg(chunks(rest).alias("asked"), chunks(total).alias("others")), "region")
    dealt = dealt.withColumn("own", F.when(F.col("main"), F.col("asked") + F.pmod(F.xxhash64("rep", F.lit(7)), F.col("others"))).otherwise(F.pmod(F.xxhash64("rep", F.lit(7)), F.col("asked"))))
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("main"), F.col("asked")).otherwise(F.col("asked") + F.col("others")) - 1)
    out = dealt.where("asked > 0").withColumn("met", F.explode(meets))  # nothing is left to do where all are main
    return out.select(F.xxhash64("region", F.least("own", "met"), F.greatest("own", "met"), F.lit("dense")).alias("region"), "rep", "tokens", "main")


def _voronoi(points: DataFrame, limit: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Split regions (region, rep, tokens) until each has at most `limit` shingles: those regions, and links found on the way.

    A region of more than `most` shingles is parted by its rarest elements before. One that hardly shrinks is left as it is up to
    `most` shingles, and else goes to _dense.
    """
    spark = points.sparkSession
    huge = written(_size(points, "region").where(F.col("total") > most).select("region"), "huge")
    if huge.limit(1).count():
        points = written(points.join(huge, "region", "left_anti").unionByName(_by_rarest(written(points.join(huge, "region", "left_semi"), "over"))), "parted")
    ready, level = None, 0
    links = spark.createDataFrame([], "a long, b long")
    while True:
        sized = written(_size(points, "region"), "sized")
        big = sized.where((F.col("total") > limit) & (F.col("n") > 2))
        small = points.join(sized.where(~((F.col("total") > limit) & (F.col("n") > 2))).select("region"), "region", "left_semi").withColumn("main", F.lit(False))
        ready = small if ready is None else ready.unionByName(small)
        if not big.limit(1).count():
            return ready, links
        chosen = _hashed_first(points.join(big.select("region"), "region", "left_semi"), level).where(F.col("k") <= PIVOTS).drop("k")
        went = _near_pivots(points, chosen, big, limit)
        links = links.unionByName(went.where("part < 0").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        split = went.where("part >= 0").select("region", "rep", "tokens", "part")
        grown = _size(split, "region", "part").groupBy("region").agg(F.max("total").alias("now"), F.sum("total").alias("all")).join(big, "region")
        # a region of which a part hardly shrank, or whose parts are mostly boundary points
        still = (F.col("now") > SHRUNK * F.col("total")) | (F.col("all") > 2 * F.col("total")) | F.lit(level + 1 >= LEVELS)
        same = written(grown.where((F.col("now") > limit) & still).select("region", "total"), "same")
        ready = ready.unionByName(points.join(same.where(F.col("total") <= most).select("region"), "region", "left_semi").withColumn("main", F.lit(False)))
        if same.where(F.col("total") > most).limit(1).count():
            links = written(links.distinct(), "links")
            ready = ready.unionByName(_dense(points.join(same.where(F.col("total") > most).select("region"), "region", "left_semi"), links, most))
        points = written(split.join(same, "region", "left_anti").select(F.xxhash64("region", "part", F.lit(level)).alias("region"), "rep", "tokens"), "regions")
        level += 1


#: Shingles of the documents a bucket of signatures on average: a task holds one bucket at a time, whatever the number of partitions.
BUCKET_SHINGLES = 4 << 20
#: Sets of more than 1 / COMMON of all rows, of which there are fewer than COMMON, find their component by broadcast.
COMMON = 1000


def similar_components(docs: DataFrame, limit: int = REGION_SHINGLES, most: int = TASK_SHINGLES) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Sets are compared by 64-bit hashes of their shingles: exact up to a collision of two of these. Null, empty and blank texts have
    no shingle and are linked with nothing. Repeated rows stay; a doc_id that occurs with
    several texts stands for all of them. Null ids take no part and get a null component. Other columns aren't read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(texts.mapInArrow(_describe, "doc_id long, n_shingles long, set_id binary, key long"), "sets")
    reps = sets.where("set_id is not null and doc_id is not null").groupBy("set_id", "key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    shingles, rows = sets.agg(F.sum("n_shingles"), F.count("*")).first()
    buckets = max(4 * shuffle_parts(spark), -(-(shingles or 0) // BUCKET_SHINGLES))
    signed = texts.where("doc_id is not null").mapInArrow(_sign(buckets), "bucket long, keys binary, counts binary, sigs binary")
    edges = signed.repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates, "a long, b long")
    blocks = components(edges)
    members = written(blocks.join(reps, blocks["node"] == reps["key"]).select(F.col("component").alias("region"), "rep"), "members")
    # merged at every size: a side that grows with the documents isn't to be broadcast when it happens to be small
    points = members.hint("merge").join(texts.where("doc_id is not null"), members["rep"] == texts["doc_id"]).select("region", "rep", "text").mapInArrow(_tokens, "region long, rep long, tokens binary")
    points = written(points.where(F.octet_length("tokens") > 0), "points")
    regions, links = _voronoi(points, limit, most)
    found = regions.select("region", "rep", "tokens", "main").repartition("region").sortWithinPartitions("region", "rep").mapInArrow(_join_all, "a long, b long")
    found = components(found.unionByName(links))
    known = reps.select("set_id", "rep", "copies").join(found, reps["rep"] == found["node"], "left").select("set_id", F.coalesce("component", "rep").alias("component_id"), "copies")
    known = written(known, "known")
    common = F.broadcast(known.where(F.col("copies") * COMMON > rows).drop("copies"))
    rare = known.where(F.col("copies") * COMMON <= rows).drop("copies")
    sets = sets.drop("key")
    asked = sets.where("set_id is not null and doc_id is not null")  # others are linked with nothing
    named = asked.join(common, "set_id").unionByName(asked.join(common, "set_id", "left_anti").join(rare, "set_id")).unionByName(sets.where("set_id is null or doc_id is null").withColumn("component_id", F.col("doc_id")))
    return named.select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they were, without those that are linked, also indirectly, to one of smaller doc_id. Rows that
    share the smallest doc_id of a group all stay, as they are one document."""
    dropped = similar_components(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
