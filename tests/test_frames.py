import glob
import os
import random
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from frameloom.functions.signals import PLACE, bits, physical_value, place
from frameloom.operators import decode, export, frames, index, query, stage, store
from frameloom.plans import catalogue
from frameloom.schemas import FRAME, MESSAGE, SIGNAL, DecodeStatus, LogQuery, RecorderState, direction_code
from frameloom.service import Engine, ParserStatusEvent, RecorderStatusEvent
from frameloom.sources import dbc, files
from frameloom.streaming import ring

SF = "/root/testdata/sf0.001"
ROWS = [(0, 418, 0.1, b"\xaa"), (1, 419, 0.2, b"\xaa"), (2, 418, 0.3, b"\xaa"), (3, 418, 0.4, b"\xaa\x00"), (4, 9000, 0.5, b"\x01"), (5, 9000, 0.6, b"\x02")]
EXPECTED = {0: (0.1, 0), 1: (0.2, 0), 2: (0.1, 0), 3: (0.3, 1), 4: (0.5, 0), 5: (0.6, 1)}


def _frames(spark):
    rows = [("a", i, i + 1, t, c, 0, len(d), d, "1") for i, c, t, d in ROWS]
    return frames.derive(spark.createDataFrame(rows, "log_id string, row_idx long, line_number long, timestamp double, can_id long, direction int, data_len int, data binary, channel string"))


def _value(x):
    return tuple(map(_value, x)) if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    result = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    order = [result.columns.index(c) for c in sorted(result.columns)]
    want = sorted((tuple(_value(r[k]) for k in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(_value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr) == want


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_derived_columns(spark):
    assert {r["row_idx"]: (r["last_timestamp"], r["changed"]) for r in _frames(spark).collect()} == EXPECTED


def test_chunks_carry_the_frame_before(spark):
    rows = _frames(spark).drop("last_timestamp", "changed")
    for size in (1, 2, 3):
        got = {r["row_idx"]: (r["last_timestamp"], r["changed"]) for r in frames.derive(rows, chunk_rows=size).collect()}
        assert got == EXPECTED
    base = catalogue.full(spark, SF)
    assert query.page_of(base, 20, 60, deep=1).collect() == query.page_of(base, 20, 60).collect() and query.page_of(base.limit(5), 7, 9, deep=1).count() == 0


def test_live_changes_equal_the_batch(spark, tmp_path):
    _frames(spark).select("log_id", "row_idx", "timestamp", "can_id", "data").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("log_id string, row_idx long, timestamp double, can_id long, data binary").parquet(str(tmp_path / "in"))
    q = ring.live_changes(stream).writeStream.format("memory").queryName("live").outputMode("append").start()
    ring.stop(q)
    assert {r["row_idx"]: (r["last_timestamp"], r["changed"]) for r in spark.table("live").collect()} == EXPECTED


def test_bits_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for _ in range(1500):
        data = rng.randbytes(rng.choice([1, 2, 8, 64]))
        length, order, signed = rng.randint(1, 64), rng.randint(0, 1), rng.randint(0, 1)
        start = rng.randrange(len(data) * 8 + 8)
        at = [start + length - 1 - k for k in range(length)] if order == 0 else [8 * (start // 8) + 7 - start % 8 + k for k in range(length)]
        want = None
        if max(at) < 8 * len(data):
            value = 0
            for b in at:
                value = value * 2 + ((data[b // 8] >> (b % 8 if order == 0 else 7 - b % 8)) & 1)
            want = value - (1 << length) if signed and value >> (length - 1) else value
            want = want - (1 << 64) if want >= 1 << 63 else want
        rows.append((data, start, length, order, signed, want))
    df = spark.createDataFrame(rows, "data binary, start_bit int, bit_length int, byte_order int, is_signed int, want long")
    got = place(df).withColumn("got", bits(F.col("data"), *(F.col(c) for c in [*PLACE, "byte_order", "is_signed"])))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    assert df.limit(1).select(physical_value(F.lit(3), F.lit(0.0), F.lit(None).cast("double"))).first()[0] == 3.0


def test_large_tables_meet_hot_keys_by_salt(spark, monkeypatch):
    rows = spark.range(900).selectExpr("'a' AS log_id", "id AS row_idx", "id / 4D AS timestamp", "CAST(IF(id % 3 = 0, id % 7, 1) AS LONG) AS can_id", "X'0A0B' AS data", "0 AS direction", "2 AS data_len", "'1' AS channel")
    signals = spark.createDataFrame([("d", c, k, f"s{k}", 8 * k + 7, 8, 1, 0, 0, 1.0, 0.0, None, None, 0, None) for c in range(5) for k in range(2)], SIGNAL)
    named = spark.createDataFrame([(c, f"M{c}") for c in range(5)], "can_id long, message_name string")

    def both():
        return sorted(map(tuple, decode.decode(rows, signals).collect())), sorted(map(tuple, export.export_rows(decode.message_names(rows, named)).collect()))

    small = both()
    monkeypatch.setattr(decode, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(decode, "CHUNK_ROWS", 100)
    assert both() == small and len(small[0]) > 900


def test_filters_and_directions(spark):
    f = _frames(spark)
    assert [direction_code(x) for x in (" RX", "tx ", 1)] == [0, 1, 1]
    with pytest.raises(ValueError):
        direction_code("up")
    assert query.read_page_filtered(f, LogQuery(can_ids=(418,)), 1, 2).select("row_idx").collect() == [(2,), (3,)]
    assert query.read_latest(f, 2, 100).select("row_idx").collect() == [(4,), (5,)]


DBC = """
BO_ 418 MsgA: 2 ECU
 SG_ Zed : 7|8@0+ (0.5,1) [0|0] "" X
 CAT_DEF_ 1 a b;
 SG_ Abe : 8|8@1- (1,0) [0|0] "" X
VAL_ 418 Abe 0 "off" 1 "on" ;
"""


def test_database_and_decode(spark):
    messages, signals = dbc.parse_dbc(DBC)
    assert messages == [(418, "MsgA", 2, 2)]
    assert signals == [(418, 0, "Abe", 8, 8, 0, 1, 1, 1.0, 0.0, None, None, 0, None), (418, 1, "Zed", 7, 8, 1, 0, 0, 0.5, 1.0, None, None, 0, None)]
    model = spark.createDataFrame([("d", *s) for s in signals], SIGNAL)
    got = decode.decode(_frames(spark), model)
    assert sorted((r["row_idx"], r["signal_name"], r["raw_value"], r["phys_value"], r["changed"]) for r in got.collect()) == [(0, "Zed", 170, 86.0, 0), (2, "Zed", 170, 86.0, 0), (3, "Abe", 0, 0.0, 0), (3, "Zed", 170, 86.0, 0)]
    assert decode.ambiguous_ids(spark.createDataFrame([(1,), (1,), (2,)], "can_id long")).collect() == [(1, "Unresolved")]
    assert decode.pairs_differ(decode.signal_pairs(got), decode.signal_pairs(got).limit(0)).count() == 2


def test_service_from_file_to_export(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"{k}.25 CAN 1 Rx 1A2 MsgA 2 {k % 3:02X} 01\n" for k in range(9)))
    (tmp_path / "a.dbc").write_text(DBC)
    heard = []
    e = Engine(spark, str(tmp_path / "root"))
    e.start()
    e.subscribe(ParserStatusEvent, heard.append)
    e.subscribe(DecodeStatus, heard.append)
    with pytest.warns(UserWarning, match="no events"):
        e.subscribe(int, heard.append)
    log = e.parse_log_file(str(tmp_path / "a.log"))
    assert [x.status for x in heard] == [2, 0] and e.frames(log).count() == 9
    assert [r["row_idx"] for r in e.read_page(log, 2, 4).collect()] == [2, 3, 4]
    base = e.parse_dbc_file(str(tmp_path / "a.dbc"))
    e.decode(log, base)
    assert e.decoded(log, base).count() == 18 and heard[-1].status == 0 and heard[-1].written == 18 and not heard[-1].reused
    e.decode(log, base)
    assert heard[-1].reused and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert [(r["row_idx"], r["can_id"]) for r in e.read_page_filtered(log, 1, 3, can_ids=(418,), directions=("Rx",), changed_only=True).collect()] == [(2, 418), (3, 418), (4, 418)]
    assert e.update_entries(spark.createDataFrame([(log, 1, b"\x00\x01")], "log_id string, row_idx long, data binary"))
    assert not e.update_entries(spark.createDataFrame([], "log_id string, row_idx long, data binary"))
    assert e.read_page(log, 1, 1).select("changed").collect() == [(0,)] and e.frames(log).count() == 9
    def lines(path):
        return b"".join(open(p, "rb").read() for p in sorted(glob.glob(path + "/part-*"))).decode().split("\r\n")

    text = lines(e.export_csv(log, str(tmp_path / "out.csv"), time_range=(0.0, 2.5)))
    assert text[0] == "Time,Channel,CAN ID,Message Name,Direction,DLC,Data" and text[2] == "0.250000,,0x1A2,UNKNOW,Rx,2,00 01" and len(text) == 2 + 6 + 5 + 1
    text = lines(e.export_csv(log, str(tmp_path / "named.csv"), dbc_id=base, wanted={1: [2]}))
    assert text[1:4] == ["Abe,Zed", "2.250000,,0x1A2,MsgA,Rx,2,02 01", "1,2"] and len(text) == 2 + 6 + 5 + 1
    assert e.export_csv(log, can_ids=(5,)) is None
    assert e.discard_decoded(log) == 1
    other, job = e.request_parse_job(str(tmp_path / "a.log"))
    assert job.result(120) == other and e.parse_status(other)[0] == 0 and e.log_path(other).endswith(other) and e.frames(other).count() == 9
    assert e.request_decode(other, base).result(120).log_id == other and e.decoded(other, base).count() == 18
    e.kill_decode(other)
    assert len(e.decode_all([(other, base), (log, base), (other, base)])) == 2
    assert e.decode(other, base, replace=True, again=True) and e.decoded(other, base).count() == 18
    e.decode(other, "none")
    assert (heard[-1].status, heard[-1].code) == (1, -102)
    spark.createDataFrame([], SIGNAL).write.mode("overwrite").parquet(f"{e.dbc_path}/{base}/signals")
    e.decode(other, base, again=True)
    assert (heard[-1].status, heard[-1].code) == (1, -103)
    (tmp_path / "b.csv").write_text("t,k,c,d,i,n,l,x,y\n0.1,CAN,1,Rx,1A2,M,2,AB,CD\nx,,,,,,,,\n0.2,CAN,1,Tx,1A3,M,2,AB,CE\n")
    assert [(r["row_idx"], r["can_id"]) for r in e.read_page(e.parse_log_file(str(tmp_path / "b.csv")), 0, 9).collect()] == [(0, 418), (1, 419)]
    (tmp_path / "text.blf").write_text("0.25 CAN 1 Rx 1A2 MsgA 2 00 01\n")
    assert e.frames(e.parse_log_file(str(tmp_path / "text.blf"))).count() == 1
    told = [(r["kind"], r["state"], r["detail"]) for r in e.events().collect()]
    assert told[:2] == [("ServiceStateEvent", "STARTING", ""), ("ServiceStateEvent", "RUNNING", "")] and ("DecodeProgressEvent", "100", "") in told and ("DecodeCompletedEvent", "DONE", "reused") in told
    e.unsubscribe_all()
    n = len(heard)
    e.stop()
    assert len(heard) == n and e.events().where("state = 'STOPPED'").count() == 1


def test_text_conversion_reads_back(spark, tmp_path):
    f = decode.message_names(_frames(spark), None)
    last = export.convert(f, str(tmp_path / "asc"), "log", 200)
    names = sorted(os.path.basename(x) for x in glob.glob(str(tmp_path / "asc" / "*.asc")))
    assert names == ["log_part1.asc", "log_part2.asc", "log_part3.asc"] and last.endswith("log_part3.asc")
    assert [len(open(tmp_path / "asc" / n).readlines()) for n in names] == [3, 2, 1] or sum(len(open(tmp_path / "asc" / n).readlines()) for n in names) == 6
    from frameloom.sources.textlog import parse_log

    back = parse_log(spark, str(tmp_path / "asc"), "b")
    assert sorted((r["can_id"], bytes(r["data"])) for r in back.collect()) == sorted((c, d) for _, c, _, d in ROWS)


def test_parts_of_a_converted_log_are_read_in_the_order_of_their_numbers(spark, tmp_path):
    from frameloom.sources.textlog import parse_log

    rows = spark.range(400).selectExpr("'a' AS log_id", "id AS row_idx", "id + 1D AS timestamp", "256 + id AS can_id", "0 AS direction", "1 AS data_len", "X'05' AS data", "'1' AS channel", "'M' AS message_name")
    export.convert(rows, str(tmp_path / "asc"), "log", 1000)
    assert (tmp_path / "asc" / "log_part10.asc").exists()
    assert [r["can_id"] for r in parse_log(spark, str(tmp_path / "asc"), "b").orderBy("row_idx").collect()] == list(range(256, 656))


def test_frames_of_one_time_keep_their_order(spark):
    rows = spark.range(300).selectExpr("299 - id AS row_idx", "(299 - id) % 3 AS us", "299 - id AS old").repartition(3)
    assert [r["old"] for r in catalogue._in_time(rows).orderBy("row_idx").collect()] == [k for us in range(3) for k in range(us, 300, 3)]


def test_blf_messages(spark, tmp_path):
    def obj(kind, ticks, body):
        size = 32 + len(body)
        return struct.pack("<4sHHIIIHHQ", b"LOBJ", 32, 1, size, kind, 2, 0, 0, ticks) + body + b"\0" * (-size % 4)

    inner = obj(1, 5 * 10**8, struct.pack("<HBBI8s", 1, 0, 2, 0x1A2, b"\xab\xcd")) + obj(100, 10**9, struct.pack("<HBBIIBBB5x64s", 2, 1, 9, 0x80000123, 0, 0, 1, 12, bytes(range(12))))
    packed = zlib.compress(inner)
    container = struct.pack("<4sHHIIH6xI4x", b"LOBJ", 16, 1, 32 + len(packed), 10, 2, len(inner)) + packed
    (tmp_path / "a.blf").write_bytes(struct.pack("<4sI", b"LOGG", 144) + b"\0" * 136 + container)
    rows = files.read_blf(spark, str(tmp_path / "a.blf"), "x").orderBy("row_idx").collect()
    assert [(r["timestamp"], r["can_id"], r["direction"], bytes(r["data"]), r["channel"], r["is_fd"]) for r in rows] == [(0.5, 0x1A2, 0, b"\xab\xcd", "0", False), (1.0, 0x123, 1, bytes(range(12)), "1", True)]
    assert [files.file_kind(x) for x in ("a.XLSX", "b.csv", "c.blf", "d.asc", "e.log", "f.bin", "g")] == ["excel", "csv", "blf", "asc", "text", "unknown", "unknown"]


def test_csv_rows_are_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,k,c,d,i,n,l,x,y\n0.1,CAN,1,Rx,1A2,M,2,AB,CD\nx,,,,,,,,\n")
    assert [(r["can_id"], bytes(r["data"])) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [(418, b"\xab\xcd")]


def test_ring_and_recorder(spark, tmp_path):
    path = str(tmp_path / "ring")
    r = ring.Ring(path, 8, create=True)
    for k in range(6):
        r.write(k / 10, 100 + k, k % 2, bytes([k]), "CAN1")
    assert [x[0] for x in r.read_latest(3)] == [3, 4, 5]
    stream = ring.ring_stream(spark, path, 8, "earliest")
    q = ring.record(stream, str(tmp_path / "t"), str(tmp_path / "c"), "L")
    assert ring.record(stream, str(tmp_path / "t2"), str(tmp_path / "c2"), "L") is None
    ring.stop(q)
    rows = spark.read.parquet(str(tmp_path / "t")).orderBy("write_idx").collect()
    assert [(x["write_idx"], x["can_id"], bytes(x["data"]), x["channel"]) for x in rows] == [(k, 100 + k, bytes([k]), "CAN1") for k in range(6)]
    for k in range(10):
        r.write(1, 1, 0, b"")
    with pytest.raises(RuntimeError, match="overrun"):
        r.read(0, 16)


def test_segments_recorder_and_events(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in (0, 40):
        part = [(n / 10, 256 + n % 3, n % 2, bytes([n % 7]), "CAN1") for n in range(k, k + 40)]
        (folder / f"{k}.seg").write_bytes(ring.segment_bytes(part, k))
    e, heard = Engine(spark, str(tmp_path / "root")), []
    e.start()
    e.subscribe(RecorderStatusEvent, heard.append)
    log = e.start_recording(ring.segment_stream(spark, str(folder)), "007")
    assert e.start_recording(ring.segment_stream(spark, str(folder))) is None
    e.pause_recording(log)
    (folder / "80.seg").write_bytes(ring.segment_bytes([(9.0, 256, 0, b"z" * 70, "a-very-long-channel")], 80))
    assert e.start_recording(ring.segment_stream(spark, str(folder)), "007") == "007"
    e.stop_recording(log)
    assert {x.state for x in heard} >= {RecorderState.PAUSED, RecorderState.STOPPED} and (RecorderState.WRITE_BATCH, RecorderState.PAUSED, RecorderState.WAIT_RING, RecorderState.STOPPED) == (1, 2, 3, 4)
    assert e.save_record(log) and e.save_record(log)
    got = e.frames(log)
    assert got.count() == 81 and set(got.columns) == set(FRAME.names)
    last = got.where("row_idx = 80").first()
    assert (last["line_number"], last["can_id"], len(last["data"]), last["changed"], last["channel"]) == (81, 256, 64, 1, "a-very-long-cha")


def test_updates_are_atomic_and_may_set_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_frames(_frames(spark).withColumn("log_id", F.lit("007")), path)
    assert store.read_frames(spark, path, "007").count() == 6
    new = spark.createDataFrame([("007", 0, None, 1), ("007", 0, "x", 0), ("007", 2, "y", 0)], "log_id string, row_idx long, channel string, update_order int")
    assert store.update_entries(spark, path, new)
    assert [(r["row_idx"], r["channel"]) for r in store.read_frames(spark, path, "007").orderBy("row_idx").collect()] == [(0, None), (1, "1"), (2, "y"), (3, "1"), (4, "1"), (5, "1")]
    (part,) = glob.glob(f"{path}/log_id=007/part-*.parquet")[:1]
    hidden = os.path.join(os.path.dirname(part), ".new-part-00000-x.parquet")
    os.rename(part, hidden)  # a crash behind the deletion of the old file
    stage._write_text(spark, f"{path}._journal-x", f"file:{part}\tfile:{hidden}")
    assert store.recover(spark, path) == 1 and store.read_frames(spark, path).count() == 6
    assert store.recover(spark, path) == 0


def test_an_update_leaves_other_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4000).selectExpr("'L' AS log_id", "id AS row_idx", "id + 1 AS line_number", "id / 4D AS timestamp", "CAST(id % 700 AS LONG) AS can_id", "0 AS direction", "1 AS data_len", "X'05' AS data", "'1' AS channel")
    frames.derive(rows).repartitionByRange(8, "row_idx").sortWithinPartitions("row_idx").write.partitionBy("log_id").parquet(path)
    before = set(os.listdir(f"{path}/log_id=L"))
    assert store.update_entries(spark, path, spark.createDataFrame([("L", 20, b"\x06")], "log_id string, row_idx long, data binary"))
    after = {f for f in os.listdir(f"{path}/log_id=L") if not f.endswith(".crc")}
    gone = {f for f in before if not f.endswith(".crc")} - after
    assert 1 <= len(gone) <= 2 and len([f for f in after if f.endswith(".parquet")]) == 8
    got = {r["row_idx"]: (bytes(r["data"]), r["changed"]) for r in store.read_frames(spark, path).where("row_idx IN (20, 720, 1420)").collect()}
    assert got == {20: (b"\x06", 0), 720: (b"\x05", 1), 1420: (b"\x05", 0)} and store.read_frames(spark, path).count() == 4000


def test_an_update_asks_the_file_system_a_few_times_a_file(spark, tmp_path, monkeypatch):
    """Folders aren't looked up file by file; a crash within the swap is finished, and nothing is left beside the table."""
    path, calls = str(tmp_path / "t"), []
    rows = spark.range(40).selectExpr("'L' AS log_id", "id AS row_idx", "id + 1 AS line_number", "id / 4D AS timestamp", "id AS can_id", "0 AS direction", "1 AS data_len", "X'05' AS data", "'1' AS channel")
    frames.derive(rows).repartitionByRange(1, "row_idx").sortWithinPartitions("row_idx").write.partitionBy("log_id").option("maxRecordsPerFile", 2).parquet(path)
    asked, swap = store._fs, store._swap
    monkeypatch.setattr(store, "_fs", lambda *a: calls.append(a) or asked(*a))
    monkeypatch.setattr(store, "_swap", lambda s, journal: stage._write_text(s, journal, stage._read_text(s, journal)))
    assert store.update_entries(spark, path, rows.selectExpr("log_id", "row_idx", "X'06' AS data")) and len(calls) < 20
    first = stage._read_text(spark, glob.glob(f"{path}._journal-*")[0]).split("\n")[0].split("\t")
    os.remove("/" + first[0].split(":", 1)[1].lstrip("/"))  # a crash behind the deletion of the first old file
    monkeypatch.setattr(store, "_swap", swap)
    assert store.recover(spark, path) == 1 and [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["t"]
    got = store.read_frames(spark, path)
    assert len(glob.glob(f"{path}/log_id=L/*.parquet")) == 20 and sorted((r["row_idx"], bytes(r["data"])) for r in got.collect()) == [(k, b"\x06") for k in range(40)]


@pytest.mark.parametrize(
    "q",
    [LogQuery(), LogQuery(can_ids=(418, 9000)), LogQuery(channels=("1",), directions=(0,)), LogQuery(changed_only=True), LogQuery(can_ids=(418,), changed_only=True, time_range=(0.2, 0.35)), LogQuery(time_range=(0.2, 0.5)), LogQuery(can_ids=(7,)), LogQuery(directions=("tx",)), LogQuery(channels=("2",), can_ids=(418,))],
)
def test_indexed_pages_equal_scanned_ones(spark, tmp_path_factory, q):
    path = str(tmp_path_factory.getbasetemp() / "indexed")
    if not index.has_indexes(spark, path, "a"):
        store.write_frames(_frames(spark), path)
        index.write_indexes(spark, path)
    for first, last in ((0, 99), (1, 2), (5, 9)):
        got = index.page_indexed(spark, path, "a", q, first, last)
        want = query.read_page_filtered(_frames(spark), q, first, last)
        assert [r["row_idx"] for r in got.collect()] == [r["row_idx"] for r in want.collect()]
    page = index.page_indexed(spark, path, "a", LogQuery(can_ids=(418,)), 1, 2)
    assert "GreaterThanOrEqual(row_idx,2)" in page._jdf.queryExecution().executedPlan().toString()


def test_last_loaded_message_and_single_frames(spark):
    rows = [("d", 5, "Zed", 1, 1), ("d", 5, "Abe", 1, 1)]
    named = decode.message_names(spark.createDataFrame([(5,), (6,)], "can_id long"), spark.createDataFrame(rows, MESSAGE).coalesce(1))
    assert {r["can_id"]: r["message_name"] for r in named.collect()} == {5: "Abe", 6: "NOT_FOUND"}
    text = DBC + "BO_ 500 Mux: 2 ECU\n SG_ Sw M : 0|8@1+ (1,0) [0|0] \"\" X\n SG_ One m1 : 8|8@1+ (1,0) [0|0] \"\" X\n SG_ Two m2 : 8|8@1+ (1,0) [0|0] \"\" X\n"
    signals = spark.createDataFrame([("d", *x) for x in dbc.parse_dbc(text)[1]], SIGNAL)
    got = decode.decode_frame(spark.createDataFrame([(500, b"\x01\x09"), (500, b"\x02\x08"), (500, b"\x03\x07")], "can_id long, data binary"), signals).collect()
    assert sorted((r["signal_name"], r["raw_value"]) for r in got) == [("One", 9), ("Sw", 1), ("Sw", 2), ("Sw", 3), ("Two", 8)]


def test_decode_store_decodes_once_and_moves_no_frames_before(spark, monkeypatch):
    plans, decoded = [], catalogue.decoded
    monkeypatch.setattr(catalogue, "decoded", lambda s, d: plans.append(decoded(s, d)) or plans[-1])
    got = {tuple(r) for r in catalogue.QUERIES["decode_store"](spark, SF).collect()}
    want = duckdb.connect()
    want.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert got == set(want.sql(catalogue.ORACLES["decode_store"]).fetchall())
    assert len(plans) == 1 and plans[0]._jdf.queryExecution().optimizedPlan().toString().count("Window [lag(") == 2  # samples and what chunks carry over


def test_store_copies_once(spark, tmp_path):
    store.write_frames(_frames(spark), str(tmp_path / "a"))
    for _ in range(2):
        assert store.save_record(spark, str(tmp_path / "a"), str(tmp_path / "b"), "a")
    assert store.read_frames(spark, str(tmp_path / "b"), "a").count() == 6


def test_parse_log_of_a_folder_of_two_dialects(spark, tmp_path):
    from frameloom.sources.textlog import parse_log

    (tmp_path / "a.txt").write_text("1.5 CANFD 1 Rx 101 MsgA 1 0 2 2 0A 0B\n2.5 CANFD 1 Tx 102 MsgA 1 0 2 2 0C 0D\n")
    (tmp_path / "b.txt").write_text("3.5 CAN 1 Rx 103 MsgA 2 01 02\n4.5 CAN 1 Tx 104 MsgA 2 03 04\n")
    rows = parse_log(spark, str(tmp_path), "log").orderBy("row_idx").collect()
    assert [(r["row_idx"], r["line_number"], r["timestamp"], r["can_id"], bytes(r["data"]).hex()) for r in rows] == [(0, 1, 1.5, 0x101, "0a0b"), (1, 2, 2.5, 0x102, "0c0d"), (2, 1, 3.5, 0x103, "0102"), (3, 2, 4.5, 0x104, "0304")]
