"""A circular buffer of live frames as a streaming source, and the recorder that appends it to a table."""

from __future__ import annotations

import json
import mmap
import struct
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.operators import stage
from frameloom.schemas import CAPPED_ID, RING_CAPACITY, RecorderState, ServiceError

# Fixed values of the ring's layout: a count of entries written so far, then the entries.
HEADER = struct.Struct("<Q")
ENTRY = struct.Struct("<dIBB64s16s34x")
#: The layout of older producers; Ring(path, entry=WIDE_ENTRY).
WIDE_ENTRY = struct.Struct("<dIBB64s16s42x")
SCHEMA = "write_idx long, timestamp double, can_id long, direction int, data_len int, data binary, channel string"


class Ring:
    """A ring in a file that the processes of one host share, for producers and a session on that host. Where executors run
    elsewhere, producers drop segments into a shared folder (segment_stream)."""

    def __init__(self, path: str, capacity: int = RING_CAPACITY, create: bool = False, entry: struct.Struct = ENTRY):
        self.capacity, self.entry = capacity, entry
        size = HEADER.size + capacity * entry.size
        if create:
            with open(path, "wb") as f:
                f.truncate(size)
        self.file = open(path, "r+b")  # noqa: SIM115
        self.map = mmap.mmap(self.file.fileno(), size)

    def close(self) -> None:
        self.map.close()
        self.file.close()

    @property
    def written(self) -> int:
        return HEADER.unpack_from(self.map)[0]

    def write(self, timestamp: float, can_id: int, direction: int, data: bytes, channel: str = "") -> int:
        """Append an entry: data up to 64 bytes, channel as 15 ASCII characters; returns its number."""
        n, data = self.written, data[:64]
        name = channel.encode("ascii", "ignore")[:15]
        self.entry.pack_into(self.map, HEADER.size + n % self.capacity * self.entry.size, timestamp, can_id, direction, len(data), data, name)
        HEADER.pack_into(self.map, 0, n + 1)
        return n

    def read(self, first: int, end: int) -> list[tuple]:
        """Entries first to end - 1; those that have been overwritten are an error, not other entries."""
        if first < self.written - self.capacity:
            raise RuntimeError(f"the ring was overrun: entries from {first} on are gone, {self.written} were written")
        out = []
        for n in range(first, end):
            if n < self.written - self.capacity:  # overtaken meanwhile
                raise RuntimeError(f"the ring was overrun: entry {n} went while it was read")
            clock, can_id, way, size, data, name = self.entry.unpack_from(self.map, HEADER.size + n % self.capacity * self.entry.size)
            out.append((n, clock, can_id, way, min(size, 64), data[: min(size, 64)], name.split(b"\0")[0].decode("ascii", "ignore")))
        return out

    def read_latest(self, n: int) -> list[tuple]:
        end = self.written
        return self.read(max(0, end - min(n, self.capacity)), end)


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.capacity, self.start = options["path"], int(options.get("capacity", RING_CAPACITY)), options.get("startingoffset", "latest")

    def _written(self) -> int:
        with open(self.path, "rb") as f:
            return HEADER.unpack(f.read(HEADER.size))[0]

    def initialOffset(self) -> dict:
        return {"n": self._written() if self.start == "latest" else max(0, self._written() - self.capacity)}

    def latestOffset(self) -> dict:
        return {"n": self._written()}

    def partitions(self, start: dict, end: dict):
        return [_Range(start["n"], end["n"])]

    def read(self, partition):
        ring = Ring(self.path, self.capacity)
        try:
            yield from ring.read(partition.first, partition.end)
        finally:
            ring.close()


class RingSource(DataSource):
    """spark.readStream.format("can_ring").option("path", ...); offsets are entry numbers, from the latest on by default."""

    @classmethod
    def name(cls) -> str:
        return "can_ring"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return _Reader(self.options)


def ring_stream(spark: SparkSession, path: str, capacity: int = RING_CAPACITY, starting: str = "latest") -> DataFrame:
    spark.dataSource.register(RingSource)
    return spark.readStream.format("can_ring").option("path", path).option("capacity", capacity).option("startingOffset", starting).load()


def record(frames: DataFrame, path: str, checkpoint: str, log_id: str, trigger: dict | None = None) -> StreamingQuery | None:
    """Append a stream of records to a frames table. A second recording of a log while one runs gives None."""
    spark = frames.sparkSession
    if any(q.name == f"record-{log_id}" for q in spark.streams.active):
        return None
    rows = frames.withColumns({"log_id": F.lit(log_id), "last_timestamp": F.col("timestamp"), "changed": F.lit(0)})
    writer = rows.writeStream.queryName(f"record-{log_id}").format("parquet").partitionBy("log_id").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()


def stop(query: StreamingQuery) -> None:
    """Take what is there, then stop."""
    query.processAllAvailable()
    query.stop()


def segment_bytes(entries, first: int) -> bytes:
    """A segment: the number of its first entry, then the entries (timestamp, can_id, direction, data, channel)."""
    packed = (ENTRY.pack(t, i, w, min(len(d), 64), d[:64], c.encode("ascii", "ignore")[:15]) for t, i, w, d, c in entries)
    return HEADER.pack(first) + b"".join(packed)


def _entries(blob: bytes) -> pd.DataFrame:
    (first,) = HEADER.unpack_from(blob)
    e = np.frombuffer(blob, np.dtype([("timestamp", "<f8"), ("can_id", "<u4"), ("direction", "u1"), ("size", "u1"), ("data", "V64"), ("channel", "S16"), ("pad", "V34")]), offset=HEADER.size)
    size = np.minimum(e["size"], 64)
    return pd.DataFrame({
        "write_idx": first + np.arange(len(e)), "timestamp": e["timestamp"], "can_id": e["can_id"].astype(np.int64), "direction": e["direction"].astype(np.int32), "data_len": size.astype(np.int32),
        "data": [d.tobytes()[:n] for d, n in zip(e["data"], size)], "channel": [c.decode("ascii", "ignore") for c in e["channel"]],
    })


_FILE = "path string, modificationTime timestamp, length long, content binary"


def _segments(reader, folder: str) -> DataFrame:
    """producer (the folder that a segment is in), first and n (its entries' numbers), and what the file source gives."""
    little = F.concat(*(F.substring(F.hex(F.substring("content", 1, HEADER.size)), k, 2) for k in range(2 * HEADER.size - 1, 0, -2)))
    files = reader.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.seg").option("recursiveFileLookup", True).load(folder)
    return files.select("*", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("producer"), F.conv(little, 16, 10).cast("long").alias("first"), ((F.col("length") - HEADER.size) / ENTRY.size).cast("long").alias("n"))


def latest_entry(spark: SparkSession, folder: str) -> tuple[int, datetime | None]:
    """The number behind the newest entry of a folder of segments, and when the newest segment was written."""
    n, at = _segments(spark.read, folder).agg(F.max(F.col("first") + F.col("n")), F.max("modificationTime")).first()
    return n or 0, at


def segment_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000, starting: str = "earliest", state: str | None = None, repeats_within: str | None = None) -> DataFrame:
    """Live frames from segments that producers drop into a folder that driver and executors share. Each segment is a task's at
    most, so that a batch runs on all executors; files_per_batch bounds it.

    starting="latest" leaves out what stood in the folder at the start, as a reader of a ring does; segments older than the newest
    aren't read at all. With a folder `state` that start is kept there, so that a later call goes on from the same entry. With
    repeats_within (such as "1 day") a segment that a producer drops again within that time is read once.
    """

    def run(batches):
        for batch in batches:
            for blob in batch["content"]:
                yield _entries(bytes(blob))

    files, least = _segments(spark.readStream.option("maxFilesPerTrigger", files_per_batch), folder), 0
    if starting == "latest":
        known = f"{state.rstrip('/')}/start" if state else None
        if known and stage.exists(spark, known):
            least, at = json.loads(stage._read_text(spark, known))
        else:
            least, at = latest_entry(spark, folder)
            at = at and at.timestamp()
            if known:
                stage._write_text(spark, known, json.dumps([least, at]))
        if at is not None:
            files = files.where(F.col("modificationTime") >= F.timestamp_seconds(F.lit(at)))
    if repeats_within:
        files = files.withWatermark("modificationTime", repeats_within).dropDuplicatesWithinWatermark(["producer", "first", "n"])
    return files.select("content").mapInPandas(run, SCHEMA).where(F.col("write_idx") >= least)


def segment_gaps(spark: SparkSession, folder: str, patience: int = 100, files_per_batch: int = 1000) -> DataFrame:
    """A stream of what is amiss with the numbers of each producer's segments: (producer, kind, first, n).

    kind lost: entries that no segment brought, once `patience` segments behind them have come (one that is only late is none);
    repeated: entries that came again. Only the heads of segments take part; a producer's state is the next number and the segments
    that wait for one before them, patience at most.
    """

    def step(key, batches, state: GroupState):
        expected, waiting = json.loads(state.getOption[0]) if state.exists else (None, [])
        out = []
        for first, n in sorted({(int(a), int(b)) for batch in batches for a, b in zip(batch["first"], batch["n"])}):
            if (expected is not None and first < expected) or any(a < first + n and first < b for a, b in waiting):
                out.append((key[0], "repeated", first, n))
                continue
            waiting.append((first, first + n))
        waiting = sorted(map(tuple, waiting))
        while waiting:
            if expected is None or waiting[0][0] == expected:
                expected = waiting.pop(0)[1]
            elif len(waiting) > patience:
                out.append((key[0], "lost", expected, waiting[0][0] - expected))
                expected = waiting.pop(0)[1]
            else:
                break
        state.update((json.dumps([expected, waiting]),))
        yield pd.DataFrame(out, columns=["producer", "kind", "first", "n"])

    heads = _segments(spark.readStream.option("maxFilesPerTrigger", files_per_batch), folder).select("producer", "first", "n")
    return heads.groupBy("producer").applyInPandasWithState(step, "producer string, kind string, first long, n long", "held string", "append", GroupStateTimeout.NoTimeout)


def watch_gaps(spark: SparkSession, folder: str, checkpoint: str, patience: int = 100, trigger: dict | None = None) -> StreamingQuery:
    """A query beside a recording that fails as soon as entries are lost."""

    def look(batch: DataFrame, _):
        lost = batch.where("kind = 'lost'").orderBy("producer", "first").first()
        if lost:
            raise ServiceError(f"{lost['producer']} has lost {lost['n']} entries from {lost['first']} on")

    return segment_gaps(spark, folder, patience).writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


_LIVE = "log_id string, row_idx long, can_id long, timestamp double, last_timestamp double, changed int"


def _changes(key, rows: pd.DataFrame, last) -> pd.DataFrame:
    """Rows of one identifier in order, with what the row before says; last: (timestamp, data) of the one before all, if any."""
    clock, data = rows["timestamp"].to_numpy(), rows["data"].to_numpy()
    before = np.append([last[0] if last else clock[0]], clock[:-1])
    earlier = np.append(np.array([last[1] if last else data[0]], object), data[:-1])
    return pd.DataFrame({"log_id": key[0], "row_idx": rows["row_idx"].to_numpy(), "can_id": key[1], "timestamp": clock, "last_timestamp": before if key[1] < CAPPED_ID else clock, "changed": (earlier != data).astype(np.int32)})


#: Groups of identifiers of a log that wait together: a batch costs some steps a group, not a row or an identifier.
LATE_GROUPS = 256
_HELD = {"row_idx": np.int64, "can_id": np.int64, "timestamp": np.float64, "data": object}
_NO_ROWS = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))


def _joined(parts) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*parts))


def _taken(rows: tuple, some) -> tuple:
    return tuple(x[some] for x in rows)


def _packed(rows: tuple) -> bytes:
    """Rows of _HELD as bytes: how many, the numbers, then each frame's length (-1: null) and the frames end to end."""
    size = np.array([-1 if d is None else len(d) for d in rows[3]], np.int32)
    return b"".join([HEADER.pack(len(size)), *(x.astype(t).tobytes() for x, t in zip(rows[:3], ("<i8", "<i8", "<f8"))), size.tobytes(), *(d for d in rows[3] if d is not None)])


def _unpacked(blob: bytes) -> tuple:
    (n,) = HEADER.unpack_from(blob)
    row, can_id, clock = (np.frombuffer(blob, t, n, HEADER.size + 8 * n * k) for k, t in enumerate(("<i8", "<i8", "<f8")))
    size = np.frombuffer(blob, np.int32, n, HEADER.size + 24 * n)
    end = HEADER.size + 28 * n + np.cumsum(np.maximum(size, 0))
    data = np.empty(n, object)
    data[:] = [None if w < 0 else blob[e - w : e] for e, w in zip(end.tolist(), size.tolist())]
    return row, can_id, clock, data


def live_changes(frames: DataFrame, lateness: int | None = None) -> DataFrame:
    """last_timestamp and changed of a stream of (log_id, row_idx, timestamp, can_id, data), with the last frame of each identifier
    of a log as state. A batch's frames of one identifier are put in order together; the source bounds a batch.

    Without lateness rows are taken to come in order from batch to batch. With it, rows may come up to so many row numbers late: they
    wait in the state, packed by groups of identifiers, until the greatest number seen is that far ahead (a watermark over row numbers), and leave in order; a row that
    is later still is dropped by the watermark, and Spark counts it (numRowsDroppedByWatermark). An end mark, a row without can_id and
    with a number beyond all others by the lateness, lets the last ones go.
    """

    def step(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values("row_idx")
        out = _changes(key, rows, state.getOption)
        state.update((float(rows["timestamp"].iloc[-1]), rows["data"].iloc[-1]))
        yield out

    def patient(key, batches, state: GroupState):
        last, held = (_unpacked(x) for x in state.get) if state.exists else (_NO_ROWS, _NO_ROWS)
        if not state.hasTimedOut:
            come = [(x["can_id"].notna(), x) for x in batches]
            held = _joined([held, *(tuple(x.loc[some, c].to_numpy(kind) for c, kind in _HELD.items()) for some, x in come if some.any())])
        known = (held[0] + 1) * 1000 <= state.getCurrentWatermarkMs()
        if known.any():
            ready = _joined([last, _taken(held, known)])
            new = np.arange(len(ready[0])) >= len(last[0])
            order = np.lexsort((ready[0], new, ready[1]))  # an identifier's last frame is before all others
            new, (row, can_id, clock, data) = new[order], _taken(ready, order)
            same = np.append(False, can_id[1:] == can_id[:-1])
            before = np.where(same & (can_id < CAPPED_ID), np.append(clock[:1], clock[:-1]), clock)
            changed = same & np.append(False, data[1:] != data[:-1])
            held, last = _taken(held, ~known), _taken((row, can_id, clock, data), np.append(can_id[1:] != can_id[:-1], True))
            yield pd.DataFrame({"log_id": key[0], "row_idx": row[new], "can_id": can_id[new], "timestamp": clock[new], "last_timestamp": before[new], "changed": changed[new].astype(np.int32)})
        state.update((_packed(last), _packed(held)))
        if len(held[0]):
            state.setTimeoutTimestamp((int(held[0].min()) + 1) * 1000)

    if lateness is None:
        return frames.groupBy("log_id", "can_id").applyInPandasWithState(step, _LIVE, "timestamp double, data binary", "append", GroupStateTimeout.NoTimeout)
    timed = frames.withColumn("_at", F.timestamp_seconds(F.col("row_idx") + 1)).withWatermark("_at", f"{lateness} seconds")
    timed = timed.withColumn("_group", F.pmod(F.hash("can_id"), F.lit(LATE_GROUPS)))
    return timed.groupBy("log_id", "_group").applyInPandasWithState(patient, _LIVE, "last binary, held binary", "append", GroupStateTimeout.EventTimeTimeout)


def none_dropped(query: StreamingQuery) -> None:
    """An error if rows came later than live_changes waits for, in the batches that Spark still keeps the progress of."""
    if n := sum(state["numRowsDroppedByWatermark"] for batch in query.recentProgress for state in batch["stateOperators"]):
        raise ServiceError(f"{n} rows came later than the lateness and were dropped")


class RecorderListener(StreamingQueryListener):
    """Tells a callback the state of one recording (a query of that name) and how many frames it has written."""

    def __init__(self, name: str, tell):
        self.name, self.tell, self.frames, self.ids = name, tell, 0, set()

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.ids.add(event.id)
            self.tell(RecorderState.WAIT_RING, self.frames)

    def onQueryProgress(self, event):
        if event.progress.name != self.name:
            return
        self.frames += event.progress.numInputRows
        self.tell(RecorderState.WRITE_BATCH if event.progress.numInputRows else RecorderState.WAIT_RING, self.frames)

    def onQueryIdle(self, event):
        if event.id in self.ids:
            self.tell(RecorderState.WAIT_RING, self.frames)

    def onQueryTerminated(self, event):
        """A pause or a stop is told by whoever asked for it."""
