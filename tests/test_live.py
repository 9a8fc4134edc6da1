"""Segments: where a reader starts, gaps and repeats of numbers, rows that come late."""

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from frameloom.operators import frames
from frameloom.plans import catalogue
from frameloom.schemas import ServiceError
from frameloom.streaming import ring

NOW = {"availableNow": True}


def drop(folder, first, n=5, name=None, age=0):
    folder.mkdir(exist_ok=True, parents=True)
    path = folder / f"{name or first}.seg"
    path.write_bytes(ring.segment_bytes([(k / 4, 256 + k % 3, 0, bytes([k % 256]), "1") for k in range(first, first + n)], first))
    if age:
        os.utime(path, (time.time() - age, time.time() - age))


def numbers(stream, tmp_path, name):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(**NOW).start()
    q.awaitTermination()
    return sorted(r[0] for r in stream.sparkSession.read.schema(ring.SCHEMA).parquet(str(tmp_path / f"{name}-out")).select("write_idx").collect())


def test_a_reader_starts_at_the_latest_entry_and_goes_on_there(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "kept")
    drop(folder, 0, age=60), drop(folder, 5, age=30)
    stream = ring.segment_stream(spark, str(folder), starting="latest", state=state)
    drop(folder, 10)
    assert numbers(stream, tmp_path, "a") == list(range(10, 15))
    drop(folder, 15)
    again = ring.segment_stream(spark, str(folder), starting="latest", state=state)  # after a restart
    assert numbers(again, tmp_path, "a") == list(range(10, 20))
    assert numbers(ring.segment_stream(spark, str(folder)), tmp_path, "b") == list(range(20))
    assert ring.latest_entry(spark, str(folder))[0] == 20


def test_repeated_segments_are_read_once_and_gaps_reported(spark, tmp_path):
    folder = tmp_path / "in"
    for first in (0, 5, 15, 20, 25):
        drop(folder / "one", first)
    drop(folder / "one", 5, name="again")
    drop(folder / "two", 0), drop(folder / "two", 5)
    assert numbers(ring.segment_stream(spark, str(folder), repeats_within="1 day"), tmp_path, "a") == sorted([*range(10), *range(15, 30), *range(10)])

    def told(patience, name):
        q = ring.segment_gaps(spark, str(folder), patience, 2).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-gaps")).option("checkpointLocation", str(tmp_path / f"{name}-gstate")).trigger(**NOW).start()
        q.awaitTermination()
        rows = spark.read.schema("producer string, kind string, first long, n long").parquet(str(tmp_path / f"{name}-gaps")).collect()
        return sorted((r["producer"].rsplit("/", 1)[-1], r["kind"], r["first"], r["n"]) for r in rows)

    patient = told(9, "p")
    assert [x for x in patient if x[1] == "lost"] == []
    assert ("one", "lost", 10, 5) in told(2, "q")
    query = ring.watch_gaps(spark, str(folder), str(tmp_path / "w"), 1, NOW)
    with pytest.raises(Exception, match="lost 5 entries from 10"):
        query.awaitTermination()
    drop(folder / "one", 10)  # it was only late
    assert [x for x in told(9, "p") if x[1] == "lost"] == []


def test_late_rows_get_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(2)
    rows = [("L", k, k / 4, 256 + rng.randrange(4), bytes([rng.randrange(3)])) for k in range(600)]
    schema = "log_id string, row_idx long, timestamp double, can_id long, data binary"
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(90))  # at most 90 numbers late
    for part in range(10):
        out = late[60 * part : 60 * part + 60] + ([("L", 10_000, 0.0, None, None)] if part == 9 else [])
        spark.createDataFrame(out, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ring.live_changes(stream, lateness=100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(**NOW).start()
    q.awaitTermination()
    got = {r["row_idx"]: (r["last_timestamp"], r["changed"]) for r in spark.read.schema(ring._LIVE).parquet(str(tmp_path / "out")).collect()}
    want = frames.derive(spark.createDataFrame(rows, schema).withColumn("direction", F.lit(0)))
    assert got == {r["row_idx"]: (r["last_timestamp"], r["changed"]) for r in want.collect()}


def test_late_entries_of_a_long_log_are_all_there(spark, tmp_path):
    """Row numbers up to ten million, far beyond the lateness."""
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") * 10_000).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue._live_late(spark, str(tmp_path))
    want = duckdb.connect()
    want.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(want.sql(catalogue.ORACLES["live_changes_late"]).fetchall())


def test_rows_dropped_by_the_watermark_are_an_error(spark, tmp_path):
    schema = "log_id string, row_idx long, timestamp double, can_id long, data binary"
    for part, k in enumerate((500, 600, 1)):
        spark.createDataFrame([("L", k, 1.0, 256, b"")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ring.live_changes(stream, lateness=100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(**NOW).start()
    q.awaitTermination()
    with pytest.raises(ServiceError, match="1 rows came later"):
        ring.none_dropped(q)


def test_late_rows_of_many_identifiers_wait_in_few_groups(spark, tmp_path):
    rng = random.Random(3)
    rows = [("L", k, k / 4, (256 if k % 2 else 9000) + rng.randrange(700), bytes(rng.randrange(2) for _ in range(rng.randrange(3))) if k % 50 else None) for k in range(3000)]
    schema = "log_id string, row_idx long, timestamp double, can_id long, data binary"
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(900))
    for part in range(3):
        out = late[1000 * part : 1000 * part + 1000] + ([("L", 10_000, 0.0, None, None)] if part == 2 else [])
        spark.createDataFrame(out, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ring.live_changes(stream, lateness=1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(**NOW).start()
    q.awaitTermination()
    want, before = [], {}
    for _, k, clock, can_id, data in rows:
        last = before.get(can_id, (clock, data))
        want.append((k, can_id, clock, last[0] if can_id < 8192 else clock, int(last[1] != data)))
        before[can_id] = (clock, data)
    assert sorted(tuple(r)[1:] for r in spark.read.schema(ring._LIVE).parquet(str(tmp_path / "out")).collect()) == want
    ring.none_dropped(q)
    assert len(before) > 1000 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 256  # a state per identifier before
