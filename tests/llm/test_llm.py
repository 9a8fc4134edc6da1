import base64
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import ann, bpe, decontaminate, graph, jaccard, language, licenses, quality, suffix, toxicity, warc
from frameloom.llm.common import fold, labelled_sample, utf8, written
from frameloom.llm.graph import components
from frameloom.llm.queries import ORACLES, QUERIES
from frameloom.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blobs string, rep string, row int"
rng = random.Random(5)
WORDS = [f"w{k}" for k in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@functools.cache
def odd_docs():
    """Nulls, empty, blank, very long and repeated texts, ties, a null id, and columns whose names the operators use themselves."""
    base = prose(80)
    texts = [None, "", "  \n", base, base, base + " more", base.replace("w1 ", "x ", 1), "ä" * 60 + prose(30), "a" * 700, "ab" * 400, prose(9000), "one two", "One  two", "¿— 12 !", prose(50) + "\n" + base[:150], "\x00\x01 nul", "All rights reserved. CC BY and cc by cc by"]
    rows = [(k, t, "en", "s", 1, "x", "y", 3) for k, t in enumerate(texts)]
    return [*rows, (3, base, "en", "s", 1, "x", "y", 3), (None, base, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_registered_queries_cover_the_operators():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def brute_suffix(rows):
    first, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first.setdefault(b[p : p + 100], (i, p)) < (i, p):
                gone[p : p + 100] = True
        spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))) if len(b) else 0
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, odd, none):
    got = suffix.dedup(odd).collect()
    want = brute_suffix([(r[0], r[1]) for r in odd_docs()])
    assert len(got) == len(odd_docs())
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    assert suffix.dedup(none).count() == 0
    docs = spark.read.parquet(SF + "/documents.parquet")
    want = brute_suffix([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op1_suffix"](spark, SF).collect()} == want


def test_suffix_dedup_of_one_id_with_several_texts(spark):
    long = prose(60)
    rows = [(1, "short"), (1, long), (1, long + prose(30)), (2, prose(20) + long), (2, prose(20) + long), (3, "z" * 900), (4, "z" * 450), (4, "y" * 99)]
    order = {r["text"]: r["h"] & (2**31 - 1) for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) h").collect()}
    docs = sorted(set(rows), key=lambda r: (r[0], order[r[1]]))
    want = brute_suffix([(k, t) for k, (_, t) in enumerate(docs)])
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *want[docs.index((i, t))]) for i, t in rows)
    extra = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, _removed int, _doc int, base string")
    kept = suffix.without_repeats(extra)
    assert kept.columns == extra.columns and kept.count() == len(rows) and suffix.without_repeats(extra.limit(0)).count() == 0


def test_hot_minimizers_are_split_into_windows(spark, odd, monkeypatch):
    line = "a line of nearly a hundred bytes that two thirds of all texts hold between words of their own"
    rows = [(k, f"{prose(30)} {line} {prose(30)}" if k % 3 else prose(60)) for k in range(60)] + [(90, line * 9), (91, prose(9) + line * 4)]
    rows += [(100 + k, t) for k, (_, t) in enumerate(rows[:9])] + [(i, t) for i, t, *_ in odd_docs() if i and i != 3 and t and len(t) > 99]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_suffix(rows)
    for limit in (1 << 12, 12, 0):  # none, the line's, all
        monkeypatch.setattr(suffix, "HOT_RUNS", limit)
        bits, hot = suffix.hot_cells(docs, 1)
        many = int(np.unpackbits(hot).sum())
        assert (many == 0) if limit > 12 else (0 < many < 60) if limit else many > 100, (limit, many)
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix.dedup(docs).collect()} == want


def test_merged_transforms_find_repeats_across_shards():
    strings = [bytes(rng.randrange(97, 100) for _ in range(rng.randint(100, 300))) for _ in range(40)]
    shared = bytes(rng.randrange(97, 123) for _ in range(130))
    strings += [b"x" + shared, shared + b"y", b"q" * 180, b"\x00" * 101 + b"\xff" * 101]
    length = np.array(list(map(len, strings)))
    found, interval = suffix.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(length) - length, length)
    places = {}
    for k, s in enumerate(strings):
        for p in range(len(s) - 99):
            places.setdefault(s[p : p + 100], []).append((k, p))
    want = sorted(sorted(v) for v in places.values() if len(v) > 1)
    groups = {}
    for (k, p), i in zip(found.tolist(), interval.tolist()):
        groups.setdefault(i, []).append((k, p))
    assert sorted(sorted(v) for v in groups.values()) == want


def test_a_bucket_of_runs_is_merged_in_parts(monkeypatch):
    own = np.random.default_rng(8)
    rows, want = [], []
    for doc in range(2):  # every key's run stands in both documents, with another end
        piece, texts = np.zeros(4000, suffix.PIECE), []
        for k in range(len(piece)):
            texts.append(np.random.default_rng(k).integers(0, 256, 180, np.uint8).tobytes() + bytes([doc]) + own.integers(0, 256, 19 + k % 7, np.uint8).tobytes())
            piece[k] = (mix_of(k), doc, 1000 * k, len(texts[-1]) - 99)
            want += [(1, 1000 * k, 81)] if doc else []
        rows.append((5, None, piece.tobytes(), b"".join(texts)))
    seen, twice = [], suffix._twice
    monkeypatch.setattr(suffix, "_twice", lambda piece, data, start: seen.append(len(data)) or twice(piece, data, start))
    monkeypatch.setattr(suffix, "MERGE_BYTES", 100_000, raising=False)
    got = [(doc, *span) for batch in suffix._merge([suffix._batch(rows, *suffix._TAGGED)]) for doc, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) for span in np.frombuffer(blob, np.int64).reshape(-1, 2).tolist()]
    assert got == want
    assert max(seen) < 110_000 and sum(seen) == sum(len(r[3]) for r in rows)  # before, all 1.6 MB at once


def mix_of(k):
    return int(suffix.mix(np.array([k], np.uint64))[0])


def brute_jaccard(rows):
    sets, link = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    link = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(link[a], link[b]), min(link[a], link[b])
                link = {i: new if c == old else c for i, c in link.items()}
    return {i: (len(sets[i]), link[i]) for i in sets}


@pytest.mark.parametrize(("limit", "most"), [(jaccard.REGION_SHINGLES, jaccard.TASK_SHINGLES), (400, 100_000), (600, 900)])
def test_jaccard_components_equal_brute_force(spark, limit, most):
    seed = prose(60).split()
    rows = []
    for k in range(90):  # a large group of near copies, of which some are too far from most
        w = list(seed)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((k, " ".join(w)))
    rows += [(200 + k, prose(n)) for k, n in enumerate([1, 4, 5, 6, 8, 9, 30, 40, 200])] + [(300 + k, t) for k, (_, t) in enumerate(rows[:5])]
    rows += [(400, None), (401, ""), (402, "a b c d e f g h"), (403, "a b c d e f g h i"), (404, "A B c d")]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), limit, most)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute_jaccard(rows)


def test_jaccard_of_a_set_and_a_signature_that_many_share(spark, monkeypatch):
    base, shared = prose(40), prose(60)
    rows = [(k, base) for k in range(60)] + [(k, f"{shared} {prose(40)}") for k in range(60, 120)] + [(k, shared + " " + WORDS[k]) for k in range(120, 160)] + [(k, None if k % 2 else " ") for k in range(160, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for common in (10, 1):  # the base is met by broadcast, nothing is
        monkeypatch.setattr(jaccard, "COMMON", common)
        assert {r["doc_id"]: tuple(r)[1:] for r in jaccard.similar_components(docs).collect()} == brute_jaccard(rows)


def test_jaccard_region_of_many_that_share_a_passage(monkeypatch):
    # 400 sets that share 60 of 100 elements and aren't linked, 40 that are linked with one of them, 100 near copies
    own = random.Random(6)

    def fresh(n):
        return [own.randrange(2**63) for _ in range(n)]

    shared, base = fresh(60), fresh(100)
    sets = [{*shared, *fresh(40)} for _ in range(400)]
    sets += [{*sorted(sets[9 * k])[5:], *fresh(3)} for k in range(40)] + [{*base[k % 9 :], *fresh(2)} for k in range(100)]
    order = own.sample(range(len(sets)), len(sets))
    sets = [sets[k] for k in order]
    calls, common = [], jaccard.Points.common
    monkeypatch.setattr(jaccard.Points, "common", lambda self, p, alive: calls.append(len(alive)) or common(self, p, alive))
    want = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    main = np.array([k >= 460 for k in order])
    for joined in (None, main):
        calls.clear()
        got = jaccard.join_region([np.array(sorted(s), np.uint64) for s in sets], main=joined)
        first = np.flatnonzero(main)[0]
        given = [] if joined is None else [(int(first), int(k)) for k in np.flatnonzero(main)]
        assert set(got) <= {*want, *((b, a) for a, b in want)}
        assert (jaccard._forest(np.array(got + given), len(sets)) == jaccard._forest(np.array(want + given), len(sets))).all()
        assert sum(calls) < 10 * len(sets)  # pivots for all pairs of the 400 would look at 80,000


def test_jaccard_cloud_of_copies_too_far_from_each_other(monkeypatch):
    # 300 sets linked with a base, 300 that are far from it by elements that others have too, some of which are linked in pairs
    own = random.Random(7)
    base, pool = ([own.randrange(2**63) for _ in range(n)] for n in (100, 2000))

    def copy(n):
        return {*own.sample(base, 100 - n), *own.sample(pool, n)}

    sets = [copy(own.randrange(9)) for _ in range(300)] + [copy(14 + own.randrange(8)) for _ in range(260)]
    sets += [{*sorted(s)[own.randrange(4) :]} for s in sets[-40:]]
    sets = own.sample(sets, len(sets))
    want = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    calls, common = [], jaccard.Points.common
    monkeypatch.setattr(jaccard.Points, "common", lambda self, p, alive: calls.append(len(alive)) or common(self, p, alive))
    got = jaccard.join_region([np.array(sorted(s), np.uint64) for s in sets])
    assert set(got) <= {*want, *((b, a) for a, b in want)}
    assert (jaccard._forest(np.array(got), len(sets)) == jaccard._forest(np.array(want), len(sets))).all()
    assert sum(calls) < 30 * len(sets)  # pivots for all of the 300 would look at 130,000


def test_jaccard_regions_over_a_task_are_parted_and_dealt(spark, monkeypatch):
    passage, seed, rows = prose(60), prose(60).split(), []
    for k in range(120):  # a passage in common, and copies of which half are too far from most
        w = list(seed)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows += [(2 * k, f"{passage} {prose(40)}"), (2 * k + 1, " ".join(w))]
    sizes, voronoi = [], jaccard._voronoi

    def seen(points, limit, most):
        regions, links = voronoi(points, limit, most)
        sizes.append(points.selectExpr("sum(octet_length(tokens) / 8)").first()[0])
        sizes.append([r[0] for r in regions.groupBy("region").agg(F.sum(F.octet_length("tokens") / 8)).select(F.col("sum((octet_length(tokens) / 8))")).collect()])
        return regions, links

    monkeypatch.setattr(jaccard, "_voronoi", seen)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 400, 1500)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute_jaccard(rows)
    # what shares the passage only is in no region; no block is much over a task's size
    assert sizes[0] > 15_000 and max(sizes[1]) < 3000 and sum(sizes[1]) < 3 * sizes[0]


def test_jaccard_odd_rows(odd, none):
    want = brute_jaccard([(r[0], r[1]) for r in odd_docs() if r[0] is not None])
    got = jaccard.similar_components(odd).collect()
    assert len(got) == len(odd_docs()) and all(tuple(r)[1:] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] and jaccard.similar_components(none).count() == 0
    kept = jaccard.without_near_duplicates(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, *(i for i, (_, c) in want.items() if c == i)}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    for hub_edges in (10**6, 5):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), hub_edges).collect()}
        assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_a_round_of_components_costs_two_shuffles_and_few_files(spark, monkeypatch):
    own, tables, parts = random.Random(6), [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(graph, "written", lambda df, tag: tables.append((df._jdf.queryExecution().executedPlan().toString(), written(df, tag))) or tables[-1][1])
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(own.randrange(500), own.randrange(500)) for _ in range(500)]
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
        files = [t.select("u", F.input_file_name().alias("f")).agg(F.countDistinct("f")).first()[0] for _, t in tables[1:]]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    root = jaccard._forest(np.array(edges), 500)
    assert got == {k: root[k] for k in {k for e in edges if e[0] != e[1] for k in e}}
    assert len(tables) > 2 and all(plan.count("Exchange ") <= 2 for plan, _ in tables[1:])
    assert max(files) <= spark.sparkContext.defaultParallelism


def test_bpe_equals_the_library_and_round_trips(spark, odd, none):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(odd, path, public_tokenizers.PATTERN, keep_ids=True).collect()
    texts = sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in odd_docs())
    for r, (_, t) in zip(sorted(got, key=lambda r: r["doc_id"] if r["doc_id"] is not None else -1), texts):
        ids = own.encode_ordinary(t)
        assert (r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0
    codec = bpe._codec(open(path, "rb").read(), public_tokenizers.PATTERN)
    # ranks out of order: a merge makes a pair that comes before other merges of its rank
    odd_ranks = {bytes([b]): b for b in range(256)} | {w: 256 + k for k, w in enumerate([b"abc", b"ca", b"bc", b"ab", b"bcbc", b"cabc", b"bca", b"aa", b"aab", b"aabc", b"cbc", b"bcb"])}
    small = bpe.Codec(b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for t, k in odd_ranks.items()), public_tokenizers.PATTERN)
    for n in range(1, 200):
        w = "".join(rng.choice("abc") for _ in range(n)).encode()
        assert small._long(w) == small._matrix([w], n)[0], w
    for w in ("a" * 2049, "ab" * 3000, "".join(rng.choice("aab") for _ in range(9000)), "".join(rng.choice("etaoin shrdlu") for _ in range(5000)), "é漢" * 1500):
        assert np.frombuffer(codec._long(w.encode()), "<u4").tolist() == np.frombuffer(codec._matrix([w.encode()], len(w.encode()))[0], "<u4").tolist()
    assert [np.frombuffer(codec._long(w.encode()), "<u4").tolist() for w in ("a", "ab", "aaaa")] == [np.frombuffer(x, "<u4").tolist() for x in codec._matrix([b"a", b"ab", b"aaaa"], 4)]
    mixed = ["".join(rng.choice("abc  \n\x1c\x85éß漢😀'sl19!") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["xyz" * 1500]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(mixed)] == [own.encode_ordinary(t) for t in mixed]


def test_language_of_held_out_and_odd_texts(spark, odd, none):
    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = QUERIES["op2_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    model = language.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert [got[k] for k in (0, 1, 2)] == ["und"] * 3 and got[3] in model.languages and got[13] == "und"
    assert language.identify(none, model).count() == 0 and language.train([]).predict(pa.array(["text", None]))[0] == ["und", "und"]
    mixed = model.predict(pa.array([" ".join(docs.where("lang = 'fr'").first()["text"].split()[:60]) + " " + " ".join(docs.where("lang = 'de'").first()["text"].split()[:20])]))
    assert mixed[0] == ["fr"] and mixed[1][0] < 0.95


def test_forward_backward_equals_one_chain():
    r = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], None, None, r.normal(size=(3, 3)), r.normal(size=3))
    row = np.array([0] * 200 + [1] * 3 + [3] * 64)
    e = r.normal(size=(len(row), 3)).astype(np.float32) * 2
    got = model.shares(e, row, 4)
    for k in (0, 1, 3):
        own, a = np.exp(e[row == k].astype(float)), np.exp(model.transitions)
        f = [np.exp(model.start) * own[0]]
        for x in own[1:]:
            f.append(f[-1] @ a * x)
            f[-1] /= f[-1].sum()
        b = [np.ones(3)]
        for x in own[:0:-1]:
            b.append(a @ (x * b[-1]))
            b[-1] /= b[-1].sum()
        m = np.array(f) * np.array(b[::-1])
        assert np.allclose(got[k], (m / m.sum(1, keepdims=True)).mean(0), atol=1e-4)
    assert (got[2] == 0).all()


def test_quality_and_toxicity_scores(spark, odd, none):
    sf, docs, labels = "/root/testdata/sf0.01", *(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for name, label, least in (("op4_quality", "quality", 0.85), ("op9_toxicity", "toxic", 0.9)):
        rows = QUERIES[name](spark, sf).join(labels, "doc_id").collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
        held = [r for r in rows if r["held_out"]]
        assert sum(r["predicted"] == r[label] for r in held) >= least * len(held)
    for kind, model in ((quality, quality.train(["good text"] * 9, ["good text", "!!! $$$"] * 9)), (toxicity, toxicity.train([("you idiot", 1), ("a fine day", 0)] * 40))):
        assert kind.score(none, model).count() == 0 and kind.score(odd, model).where("score between 0 and 1").count() == len(odd_docs())
    assert quality.train([], []).scores(*utf8(pa.array(["x"])))[0] > 0.5 and toxicity.train([]).scores(*utf8(pa.array(["x", None]))).max() < 0.5
    model = toxicity.train([("you are a stupid idiot here now", 1), ("what a nice warm day we have", 0)] * 60)
    bad, misspelt, good = model.scores(*utf8(pa.array(["stupid idiot", "stupidd idiott", "nice warm day"])))
    assert bad > 0.5 and misspelt > 0.5 > good
    kept = toxicity.without_toxic(odd, toxicity.train([]))
    assert kept.columns == odd.columns and kept.count() == len(odd_docs())


def plain_words(text):
    """Words of letters, digits and bytes beyond ASCII, A-Z and accented capitals in lower case."""
    low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "").encode()
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", low)]


def test_language_query_equals_words_one_by_one(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()
    model = language.fit(spark.read.parquet(SF + "/documents.parquet"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op2_language"](spark, SF).collect()}
    a = np.exp(model.transitions.astype(float))
    for r in sorted(docs, key=lambda r: len(r["text"] or ""))[:120:3]:
        own = []
        for w in plain_words(r["text"]):
            text, starts = language.spaced(*utf8(pa.array([w])))
            own.append(model.emissions(text, *language.words(text, starts)[:2])[0])
        if not own or not re.search(r"[^\W\d_]", r["text"]):
            assert got[r["doc_id"]][0] == "und"
            continue
        e = np.exp(np.array(own, float))
        f = [np.exp(model.start) * e[0]]
        for x in e[1:]:
            f.append((f[-1] / f[-1].sum()) @ a * x)
        b = [np.ones(len(a))]
        for x in e[:0:-1]:
            b.append(a @ (x * b[-1]))
            b[-1] /= b[-1].sum()
        m = np.array(f) * np.array(b[::-1])
        mean = (m / m.sum(1, keepdims=True)).mean(0)
        assert got[r["doc_id"]][0] == model.languages[int(mean.argmax())] and abs(got[r["doc_id"]][1] - mean.max()) < 1e-3


def test_toxicity_query_equals_words_one_by_one(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op9_toxicity"](spark, SF).collect()}
    seen = {}

    def value(w):
        if w not in seen:
            text, starts = toxicity.spaced(*utf8(pa.array([w])))
            first, end, _ = toxicity.words(text, starts)
            bucket = toxicity._grams(text, first, end, toxicity.word_hashes(text, first, end))[1]
            seen[w] = float(model.weights[bucket].mean())
        return seen[w]

    for r in sorted(docs.collect(), key=lambda r: len(r["text"] or ""))[:120:3]:
        w = plain_words(r["text"])
        w = [x for k, x in enumerate(w) if not k or x != w[k - 1]]
        want = min(model.bias, 0) if not w else 30 * sum(map(value, w)) / max(8, len(w)) + model.bias
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(want, -30, 30)))) < 1e-3


def test_quality_query_equals_counts_one_by_one(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op4_quality"](spark, SF).collect()}
    groups = [range(97, 123), range(65, 91), range(48, 58), [32], [10, 13], range(128, 256), [33, 63], [46, 44, 59, 58], [124], [35, 36, 37, 38, 42]]
    for r in docs.collect()[::5]:
        b, w = (r["text"] or "").encode(), plain_words(r["text"])
        size, n = max(1, len(b)), max(1, len(w))
        kinds = [sum(x in g for x in b) / size for g in groups]
        kinds = [1 - sum(kinds) if b else 0.0, *kinds]
        low = [64 if 65 <= x < 91 else 48 if 48 <= x < 58 else x for x in b]
        pairs = np.zeros(quality.PAIRS)
        for x, y in zip(low, low[1:]):
            pairs[((x * 257 + y) * 0x9E3779B1 & 0xFFFFFFFF) >> 23] += 1 / size
        distinct = len(set(w)) / n
        other = [distinct, distinct * np.log1p(n) / 8, sum(x == y for x, y in zip(w, w[1:])) / n, sum(len(x.encode("utf-8")) for x in w) / n / 10, np.log1p(size) / 10, kinds[2] / (kinds[1] + kinds[2] + 0.01)]
        x = (np.concatenate([np.sqrt(np.maximum(kinds, 0)), other, np.sqrt(pairs)]) - model.mean) / model.spread
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))) < 1e-3, r["doc_id"]


def test_leaks_query_equals_full_alignment(spark):
    """Every short document against every item: the best semi-global alignment of the item's passages says which are held."""
    docs = [r for r in spark.read.parquet(SF + "/documents.parquet").collect() if r["text"]]
    items = [r for r in spark.read.parquet(SF + "/benchmark.parquet").collect() if r["text"]]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    plain = lambda t: " ".join(plain_words(t)).encode()
    held = sorted({d for d, _ in got})[:6]
    some = [r for r in docs if r["doc_id"] in held] + sorted((r for r in docs if r["doc_id"] not in held), key=lambda r: len(r["text"]))[40:46]
    texts = [np.frombuffer(plain(r["text"]), np.uint8) for r in some]
    line = np.concatenate([np.append(t, 0) for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    step = np.arange(len(line) + 1)
    want = set()
    for item in items[:: max(1, len(items) // 10)] + [i for i in items if any(i["item_id"] == x for d, x in got if d in held)][:6]:
        whole = plain(item["text"])
        parts = [whole] if len(whole) <= 512 else [whole[k : k + 512] for k in range(0, len(whole) - 256, 256)]
        parts += [whole[k : k + 96] for k in [*range(0, len(whole) - 96, 24), len(whole) - 96]] if len(whole) > 96 else []
        for part in parts:
            budget = min(int(0.06 * len(part)), max(0, len(part) - 10) // 10)
            cost = np.zeros(len(line) + 1, int)
            for byte in part:
                best = np.minimum(cost[1:] + 1, cost[:-1] + (line != byte))
                cost = np.minimum.accumulate(np.concatenate([[cost[0] + 1], best]) - step) + step
            want |= {(some[k]["doc_id"], item["item_id"]) for k in set(owner[np.flatnonzero(cost[1:] <= budget)])}
    tried = {x for _, x in want} | {i["item_id"] for i in items[:: max(1, len(items) // 10)]}
    assert want and {(d, x) for d, x in got if d in {r["doc_id"] for r in some} and x in tried} == want


def test_toxicity_beats_saying_no(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op9_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(sf + "/labels.parquet"), "doc_id").join(spark.read.parquet(sf + "/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    share = lambda rows: sum(r["predicted"] for r in rows) / len(rows)
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert (share(toxic) + 1 - share(clean)) / 2 >= 0.8 and share(clean) <= 0.07  # saying no always gives 0.5
    by = {lang: share([r for r in toxic if r["lang"] == lang]) for lang in ("en", "de", "fr", "es")}
    assert by["en"] >= 0.8 and min(by.values()) > 0.4, by


def test_pipeline_of_odd_repeated_and_no_rows(spark, odd, none, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(SF + "/documents.parquet").limit(60).collect()
    rows = [tuple(r) for r in docs] + [(None, docs[0]["text"], None, None, None), (900001, None, "en", "s", 0), (900002, "", "en", "s", 0), tuple(docs[3]), (900003, docs[3]["text"] + " more", "en", "s", 9)]
    for name, some in (("odd", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        for t in ("labels", "benchmark"):
            table = spark.read.parquet(f"{SF}/{t}.parquet")
            (table if some else table.limit(0)).write.parquet(f"{at}/{t}.parquet")
        out = p.run(spark, at).collect()
        assert (len(out) > 50 and {900001, 900002, None} <= {r["doc_id"] for r in out} and 900003 not in {r["doc_id"] for r in out}) if some else out == []


def test_toxicity_of_places_rare_grams_and_long_texts(spark):
    model = toxicity.train([("you are a stupid idiot here now", 1), ("what a nice warm day we have", 0)] * 60)
    calm = "what a nice warm day we have".split()
    texts = [" ".join([*(calm * 3)[:k], "stupid", "idiot", *(calm * 3)[: 20 - k]]) for k in range(21)]
    alone = model.scores(*utf8(pa.array(["stupid idiot", "nice warm day"])))
    got = model.scores(*utf8(pa.array(texts)))
    assert np.ptp(got) < 1e-3 and alone[0] > 0.5 > alone[1]  # it doesn't matter where in a text its words stand
    values = np.zeros(toxicity.BUCKETS) + 1.0
    one, other = (toxicity.Model(values, -0.5).scores(*utf8(pa.array([t]))) for t in ("a b c d e f g h", "a b c d e f g h i"))
    assert abs(one[0] - other[0]) < 1e-9  # an average, not a sum
    r = random.Random(3)
    sample = [(" ".join(r.choice(WORDS) for _ in range(12)), int(k < 600)) for k in range(1200)]
    for k in range(40):  # an insult of 40 in 1,240 texts
        sample.append(("zurriago gaznapiro", 1))
    bad, good = toxicity.train(sample).scores(*utf8(pa.array(["zurriago gaznapiro", "w1 w2 w3"])))
    assert bad > 0.5 and bad > good
    docs = spark.createDataFrame([(k, ("x" if k == 2 else "y") * 9000) for k in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") == 2).cast("int").alias("toxic"))
    got = labelled_sample(docs, labels, "toxic", 5, 0, 800, 90_000)
    assert ("x" * 9000, 1) in got and sum(len(t) for t, y in got if not y) == 90_000


def test_prior_is_estimated_from_positives_and_unlabelled():
    r = np.random.default_rng(2)
    positive, unlabelled = r.normal(2, 1, (800, 2)), np.concatenate([r.normal(2, 1, (1200, 2)), r.normal(-3, 1, (800, 2))])
    assert abs(quality.estimated_prior(positive, unlabelled) - 0.6) < 0.12


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 70_000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 70_001
    rows = [(1, "u1", "same"), (2, "u2", "same"), (9, "u9", "same"), (3, "u", None), (4, "u", ""), (5, None, big), (6, "u\r\nX: y", "WARC/1.1\r\n"), (7, "u", "a\r\n\r\n"), (7, "u", "a\r\n\r\n"), (8, "u", "\r\n\r\nWARC/1.1"), (None, "u", "same"), (None, "u", "lone")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    for chunk in (64 << 10, 7):
        some = pages if chunk > 7 else pages.where("page_id is null or page_id <> 5")
        got = sorted(map(repr, map(tuple, warc.round_trip(some, chunk).select("page_id", "payload_digest", "payload_bytes", "record_type", "refers_to").collect())))
        want = []
        for page, _, html in rows:
            b = (html or "").encode()
            if chunk == 7 and page == 5:
                continue
            keep = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
            revisit = keep is not None and page != keep
            want.append(repr((page, base64.b32encode(hashlib.sha1(b).digest()).decode(), len(b), "revisit" if revisit else "response", keep if revisit else None)))
        assert got == sorted(want)
    small = warc.round_trip(pages, least_revisit=5).where("page_id = 1").first()
    assert small["record_type"] == "response" and warc.round_trip(pages.limit(0)).count() == 0


def test_leaks_with_edits_and_without(spark, odd, none):
    items = [(k, prose(40)) for k in range(6)] + [(6, None), (7, ""), (8, "short"), (9, prose(300))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[1][1].replace(" ", "  ", 3).upper()[:60] + "zz" + items[1][1].upper()[62:]
    far = " ".join(w if k % 2 else "zzzz" for k, w in enumerate(items[2][1].split()))
    texts = {10: prose(50) + ". " + items[0][1] + "! " + prose(50), 11: "ÄÖ " + edited, 12: far, 13: prose(200), 14: items[3][1], 15: None, 16: "", 17: prose(20) + " " + " ".join(items[9][1].split()[50:220]), 18: items[4][1] + " " + items[4][1]}
    got = decontaminate.leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(10, 0), (11, 1), (14, 3), (17, 9), (18, 4)}
    for r in got:
        part = texts[r["doc_id"]].encode()[r["start"] : r["stop"]].decode()
        if r["doc_id"] in (10, 14, 18):
            assert part == items[r["item_id"]][1] and r["edits"] == 0
        if r["doc_id"] == 11:
            assert 1 <= r["edits"] <= 0.06 * r["passage_bytes"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, start string")
    assert sorted(r[0] for r in decontaminate.without_leaks(docs, bench).collect()) == [12, 13, 15, 16]
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0


def test_parts_of_items_of_any_offset_and_short_items(spark):
    def edits_of(pattern, text):
        row = np.zeros(len(text) + 1, int)
        for i, a in enumerate(pattern, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(k, "".join(r.choice(letters) for _ in range(n))) for k, n in enumerate([97, 130, 300, 500, 513, 740, 1500])] + [(90, "Yes, no"), (91, "!?")]
    index, n = decontaminate.Index(items), 0
    for k, item in items[:7]:
        for size in (119, 150, 300, 512, 739):
            for begin in {0, 1, 23, 131, 255, 400, len(item) - size}:
                if not 0 <= begin <= len(item) - size:
                    continue
                part = list(item[begin : begin + size])
                for _ in range(n % 3 if size > 119 else 0):
                    part[r.randrange(size)] = "0"
                text = "intro words " + "".join(part) + " outro"
                n += 1
                (got,) = index.search(*utf8(pa.array([text], pa.large_string())))
                assert got[:2] == (0, k) and got[5] >= 96 and got[4] <= 0.06 * got[5]
                if size < 200 and len(item) < 600:
                    assert edits_of(text[got[2] : got[3]], item) <= got[4]
    assert n > 50
    docs = [(1, "so yes no it is"), (2, "eyes no"), (3, "yes not"), (4, "x yes"), (5, "no"), (6, "YES -- no")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"], x["start"], x["stop"]) for x in found.collect()} == {(1, 90, 3, 9), (6, 90, 0, 9)}


def test_alignment_equals_full_dynamic_programming():
    for _ in range(200):
        p, t = ([rng.randrange(3) for _ in range(n)] for n in (rng.randint(1, 12), rng.randint(0, 20)))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.align(np.array(p, np.uint8), np.array(t, np.uint8), -25, 25)[0] == min(row)


def test_licenses(spark, odd, none):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    result = con.sql(ORACLES["op8_licenses"])
    rows = QUERIES["op8_licenses"](spark, SF).select(*result.columns).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(result.fetchall(), key=repr)
    got = [r for r in licenses.scan(odd).collect() if r["doc_id"] in (0, 16)]
    assert {tuple(r) for r in got} == {(0, 0, 0, None, None, "", "", 0.0), (16, 10, 4, 0, 8, "cc-by,reserved", "cc-by,reserved", 1.0)} or got[1]["n_base"] == 4
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == len(odd_docs())


def test_wrapped_notices_and_letters_beyond_ascii(spark):
    texts = [
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met:", "licensed under the\n\nGNU Affero General Public License",
        "This wor\u212a \u0130s m\u0130t", "released under\nthe MIT license",
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "bsd", 1: "agpl,gpl", 2: "", 3: "mit"}


def test_every_notice_is_found_and_taken_for_no_other(spark):
    """Each notice as it is, each with a fifth of its other words gone, each name in a sentence; and texts that only sound like one."""
    r = random.Random(4)
    base = {"affero general public license": ["gpl"], "lesser general public license": ["gpl"], "general public license": ["gpl"], "cc by": ["cc-by"]}
    own = lambda text: {x for phrase, labels in {**base, **{n: [v] for n, v in licenses.NAMES.items()}}.items() if f" {phrase} " in f" {text} " for x in labels}
    cases = []
    for label, (text, must) in licenses.TEMPLATES.items():
        cases.append((text, {label} | own(text)))
        spare = [w for w in dict.fromkeys(text.split()) if w not in must.split() and w not in "general public license apache"]
        gone = set(r.sample(spare, min(len(spare), int(len(set(text.split())) * 0.2))))
        less = " ".join(w for w in text.split() if w not in gone)
        cases.append((less, {label} | own(less)))
        gone = must.split()[-1]
        other = " ".join(w for w in text.split() if w != gone)
        cases.append((other, own(other) | ({"gpl-program"} if label == "agpl" else set())))
    for name, label in licenses.NAMES.items():
        cases.append((f"released under the {name} 4 as said", own(f"released under the {name} 4 as said")))
        assert label in cases[-1][1]
    cases += [("Licensed under CC BY 4.0", {"cc-by"}), ("released under the license of the state", set()), ("This work is licensed under the GNU General Public License, version 3", {"gpl"}), ("the license was granted free of charge to any person by the public", set()), ("software distributed under the license version 2", set()), ("copyright of all rights that are reserved", set())]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {x["doc_id"]: set(filter(None, x["labels"].split(","))) for x in licenses.scan(docs).collect()}
    assert {k: got[k] for k, (_, want) in enumerate(cases) if got[k] != want} == {}, [cases[k] for k in got if got[k] != cases[k][1]][:3]


def test_nearest_neighbours(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(900, 16)).astype(np.float32)
    rows = [(k, x.tolist(), k) for k, x in enumerate(v)] + [(1000 + k, v[0].tolist(), 1) for k in range(60)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [1.0], 0), (2100, [], 0), (None, v[1].tolist(), 0), (20, v[20].tolist(), 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for x in ann.search(df).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = ann.exact(df.where("embedding is not null and size(embedding) = 16"))
    assert got.keys() == want.keys()  # that of another length is alone and finds nothing
    two = spark.createDataFrame([(k, [float(k), 1.0] if k % 2 else [float(k), 1.0, 2.0]) for k in range(45)], "vec_id long, embedding array<double>")
    assert {(x["query_id"], x["vec_id"] % 2) for x in ann.search(two).collect()} == {(0, 0), (20, 0), (40, 0)}
    for q in got:
        assert [x[0] for x in sorted(got[q])] == list(range(1, 21)) and q not in [x[1] for x in got[q]]
        order = [(-s, i) for _, i, s in sorted(got[q])]
        assert order == sorted(order)
    assert np.mean([len({x[1] for x in got[q]} & {i for i, _ in want[q]}) / 20 for q in got]) >= 0.9
    assert [x[1] for x in sorted(got[0])][:20] == [1000 + k for k in range(20)]
    assert ann.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in ann.search(few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]


def test_recall_of_the_registered_search(spark):
    for sf in ("sf0.01", "sf0.1"):
        got = {}
        for x in QUERIES["op10_ann"](spark, f"/root/testdata/{sf}").collect():
            got.setdefault(x["query_id"], {})[x["vec_id"]] = x["score"]
        want = ann.exact(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
        assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
        assert np.mean([len(got[q].keys() & {i for i, _ in want[q]}) / 20 for q in got]) >= 0.91
    few = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = {(x["query_id"], x["vec_id"]) for x in ann.search(few, share=1.0).collect()}
    assert whole == {(q, i) for q, found in ann.exact(few).items() for i, _ in found}


def test_shingles_and_folds(spark):
    a, b, c, d = shingle_sets(pa.array(["A b\tc d e f", "a b c d e f", "x y", None]))
    assert (a == b).all() and len(a) == 2 and len(c) == 1 and len(d) == 0
    assert [r[0] for r in spark.range(50).select(fold("id", 5)).collect()] == [zlib.crc32(str(k).encode()) % 5 for k in range(50)]


def test_pipeline_stages_hold_on_their_inputs(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(SF + "/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, SF).cache()
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            want = brute_jaccard([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in after} == {i for i, (_, c) in want.items() if c == i}
        if k == 2:
            want = brute_suffix([(r["doc_id"], r["text"]) for r in before])
            for r in after:
                n, gone, _, digest = want[r["doc_id"]]
                assert gone or hashlib.sha256(r["text"].encode()).hexdigest() == digest
                assert n - gone - 8 * (want[r["doc_id"]][2] + 1) <= len(r["text"].encode()) <= n - gone
        if k in (0, 3):
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) > 0.7 * len(before)
        if k == 4:
            assert len(after) == len(before)
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, after))
    assert docs.where(F.col("n_tokens").isNull()).count() == 0
