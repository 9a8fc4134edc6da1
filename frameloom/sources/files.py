"""Other inputs: BLF containers, ASC, CSV and Excel, by extension."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.functions.lexer import collapse
from frameloom.operators.decode import sized
from frameloom.operators.frames import derive
from frameloom.operators.stage import staged
from frameloom.schemas import ServiceError
from frameloom.sources.textlog import FIELDS, numbered, parse_lines, parse_log, with_splits

KINDS = {"xls": "excel", "xlsx": "excel", "csv": "csv", "blf": "blf", "asc": "asc", "log": "text", "txt": "text"}
# Fixed values of the BLF container format.
CONTAINER, CAN_MESSAGE, CAN_MESSAGE2, CAN_FD_MESSAGE, CAN_FD_MESSAGE_64 = 10, 1, 86, 100, 101
BLF_MARK, MARK = b"LOGG", b"LOBJ"
#: Objects in a row that make it certain where one starts.
CHAIN = 4
#: Frames that leave a BLF file at a time.
BATCH_ROWS = 50_000


def file_kind(path: str) -> str:
    return KINDS.get(path.rsplit(".", 1)[-1].lower(), "unknown") if "." in path else "unknown"


def _objects(data: bytes, at: int = 0):
    """(kind, header size, bytes) of the complete objects of data, then (None, 0, rest)."""
    while (at := data.find(MARK, at)) >= 0 and at + 16 <= len(data):
        header, _, size, kind = struct.unpack_from("<HHII", data, at + 4)
        if size < 16:
            break
        if at + size > len(data):
            break
        yield kind, header, data[at : at + size]
        at += size
    yield None, 0, data[at:] if at >= 0 else data[-3:]


def _entry(data: bytes, kinds: tuple[int, ...] | None, chain: int) -> int:
    """Where the first object starts in data that may start within one, or -1 while that isn't certain.

    From there on `chain` objects with plausible headers, of the given kinds if any, must follow one another with at most three bytes
    to fill up between them; a mark within a payload starts no such chain.
    """
    start = -1
    while (start := data.find(MARK, start + 1)) >= 0:
        at = start
        for _ in range(chain):
            if at + 16 > len(data):
                return -1
            header, version, size, kind = struct.unpack_from("<HHII", data, at + 4)
            if not (16 <= header <= min(size, 64) and version <= 4 and size < 1 << 28 and (kind < 256 if kinds is None else kind in kinds)):
                break
            if at + size + 7 > len(data):
                return -1
            if (at := data.find(MARK, at + size, at + size + 7)) < 0:
                break
        else:
            return start
    return -1


def _message(kind: int, header: int, obj: bytes):
    """(timestamp, can_id, direction, data_len, data, channel, is_fd) of an object, or None if it is no message."""
    if kind not in (CAN_MESSAGE, CAN_MESSAGE2, CAN_FD_MESSAGE, CAN_FD_MESSAGE_64):
        return None
    flags, _, _, ticks = struct.unpack_from("<IHHQ", obj, 16)
    clock, body = ticks / (1e9 if flags == 2 else 1e5), obj[header:]
    if kind in (CAN_MESSAGE, CAN_MESSAGE2):
        channel, way, dlc, can_id = struct.unpack_from("<HBBI", body)
        data, way, fd = body[8 : 8 + min(dlc, 8)], way & 1, False
    elif kind == CAN_FD_MESSAGE:
        channel, way, _, can_id, _, _, flag, valid = struct.unpack_from("<HBBIIBBB", body)
        data, way, fd = body[20 : 20 + min(valid, 64)], way & 1, bool(flag & 1)
    else:
        channel, _, valid, _, can_id, _, flag = struct.unpack_from("<BBBBIII", body)
        data, way, fd = body[40 : 40 + min(valid, 64)], int(body[34] != 0), bool(flag & 0x1000)
    return clock, can_id & 0x1FFFFFFF, way, len(data), data, str(channel - 1), fd


def _inflated(obj: bytes) -> bytes:
    (method,) = struct.unpack_from("<H", obj, 16)
    return zlib.decompress(obj[32:]) if method == 2 else obj[32:]


class _Stream:
    """Messages of consecutive pieces of a file; an object may straddle pieces and containers.

    A stream that starts within a file keeps what stands before its first object: `outer` of the file, `inner` of the containers.
    """

    def __init__(self, whole: bool):
        self.raw, self.rest, self.outer, self.inner, self.synced, self.in_sync = b"", b"", b"", b"", whole, whole

    def push(self, data: bytes):
        self.raw += data
        if not self.synced:
            if (at := _entry(self.raw, (CONTAINER,), 1)) < 0:
                return
            self.outer, self.raw, self.synced = self.raw[:at], self.raw[at:], True
        raw, self.raw = self.raw, b""
        for kind, header, obj in _objects(raw):
            if kind is None:
                self.raw = obj
            elif kind == CONTAINER:
                yield from self.inflate(_inflated(obj))
            elif (message := _message(kind, header, obj)) is not None:
                yield message

    def inflate(self, data: bytes):
        self.rest += data
        if not self.in_sync:
            if (at := _entry(self.rest, None, CHAIN)) < 0:
                return
            self.inner, self.rest, self.in_sync = self.rest[:at], self.rest[at:], True
        rest, self.rest = self.rest, b""
        for kind, header, obj in _objects(rest):
            if kind is None:
                self.rest = obj
            elif (message := _message(kind, header, obj)) is not None:
                yield message

    def edges(self) -> dict:
        """What the neighbours of this piece need: the beginnings that weren't parsed, and the ends."""
        if not self.synced:
            return {"outer": self.raw, "inner": b"", "rest": b"", "raw": b"", "synced": False, "in_sync": False}
        if not self.in_sync:
            return {"outer": self.outer, "inner": self.rest, "rest": b"", "raw": self.raw, "synced": True, "in_sync": False}
        return {"outer": self.outer, "inner": self.inner, "rest": self.rest, "raw": self.raw, "synced": True, "in_sync": True}


def _opened(head: bytes) -> bytes:
    """The objects of a file's beginning, without its header."""
    if head[:4] != BLF_MARK:
        raise ValueError("not a BLF file")
    return head[struct.unpack_from("<I", head, 4)[0] :]


def blf_messages(data: bytes):
    """Messages of a BLF file's bytes in order."""
    yield from _Stream(True).push(_opened(data))


_MESSAGE = "timestamp double, can_id long, direction int, data_len int, data binary, channel string, is_fd boolean"
_PIECE = f"file string, split long, place long, {_MESSAGE}, outer binary, inner binary, rest binary, raw binary, synced boolean, in_sync boolean"
_FIELDS, _EDGES = [f.split()[0] for f in _MESSAGE.split(", ")], ["outer", "inner", "rest", "raw", "synced", "in_sync"]


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in _PIECE.split(", "))])


def _batch(columns: dict[str, list], rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _frame_rows(file: str, split: int, first: int, messages: list[tuple]) -> pa.RecordBatch:
    n = len(messages)
    return _batch({"file": [file] * n, "split": [split] * n, "place": list(range(first, first + n)), **dict(zip(_FIELDS, zip(*messages)))}, n)


def _blf_pieces(batches):
    """The records of a scan that ends lines at MARK: messages of each split, then a row with its edges (place: their number)."""
    stream, at, count, head = None, None, 0, b""

    def closed():
        return _batch({k: [v] for k, v in {"file": at[0], "split": at[1], "place": count, **stream.edges()}.items()}, 1)

    for batch in batches:
        held = []
        for file, split, record in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (file, split):
                if held:
                    yield _frame_rows(*at, count - len(held), held)
                    held = []
                if stream is not None:
                    yield closed()
                stream, at, count, head = _Stream(split == 0), (file, split), 0, b""
            if split == 0 and head is not None:  # the header, of which a mark may be part
                head += (MARK if head else b"") + record
                if head[:4] != BLF_MARK:
                    raise ValueError(f"{file} is not a BLF file")
                if len(head) < 8 or len(head) < struct.unpack_from("<I", head, 4)[0]:
                    continue
                record, head = _opened(head), None
            else:
                record = MARK + record
            for message in stream.push(record):
                held.append(message)
                count += 1
                if len(held) >= BATCH_ROWS:
                    yield _frame_rows(*at, count - len(held), held)
                    held = []
        if held:
            yield _frame_rows(*at, count - len(held), held)
    if stream is not None:
        yield closed()


def _blf_joints(batches):
    """Edges in the order of files and splits: the messages that straddle two splits, numbered behind those of the first."""
    file, rest, raw, place = None, b"", b"", (0, 0)
    for batch in batches:
        for edge in batch.to_pylist():
            if edge["file"] != file:
                file, rest, raw, place = edge["file"], b"", b"", (edge["split"], edge["place"])
                rest, raw = edge["rest"], edge["raw"]
                continue
            join = _Stream(True)
            join.rest, join.raw = rest, raw
            messages = list(join.push(edge["outer"]))
            if edge["synced"]:
                messages += join.inflate(edge["inner"])
                if (edge["in_sync"] and join.rest.strip(b"\0")[3:]) or len(join.raw) > 3:
                    raise ServiceError(f"{file}: the objects before byte {edge['split']} don't fit those behind; read it with fewer splits")
            if messages:
                yield _frame_rows(file, *place, messages)
                place = place[0], place[1] + len(messages)
            rest, raw = (edge["rest"], edge["raw"]) if edge["in_sync"] else (join.rest, edge["raw"] if edge["synced"] else join.raw)
            if edge["place"] or edge["in_sync"]:
                place = edge["split"], edge["place"]


def read_blf(spark: SparkSession, path: str, log_id: str) -> DataFrame:
    """Frames of BLF files of any size, by as many tasks as the files have splits.

    The scan ends its records at the mark that starts every object, so that no cell holds more than a container. A split's task
    syncs to its first object, parses container after container, and leaves the bytes at its edges; these, a row per split, are
    joined in order, which gives the messages that straddle two splits.
    """
    scan = with_splits(spark.read.option("lineSep", MARK.decode()).text(path), F.col("value").cast("binary"))
    pieces = staged(scan.select("file", "split", F.col("line").alias("record")).mapInArrow(_blf_pieces, _PIECE), "blf")
    edges = pieces.where("synced IS NOT NULL").select("file", "split", "place", *_EDGES).repartition("file").sortWithinPartitions("file", "split")
    joints = edges.mapInArrow(_blf_joints, _PIECE)
    messages = staged(pieces.where("synced IS NULL").unionByName(joints).select("file", "split", "place", *_FIELDS), "blf-messages")
    first = messages.groupBy("file", "split").agg(F.count("*").alias("own"))  # a row per split
    before = F.coalesce(F.sum("own").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = numbered(messages.join(sized(first.select("file", "split", before.alias("earlier"))), ["file", "split"]).withColumn("line_number", F.col("earlier") + F.col("place") + 1))
    return derive(rows.select(F.lit(log_id).alias("log_id"), "row_idx", "line_number", *_FIELDS))


def is_blf(spark: SparkSession, path: str) -> bool:
    """Whether a file starts like a BLF file, on any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(x & 255 for x in (stream.read() for _ in range(4))) == BLF_MARK
    finally:
        stream.close()


def _joined(columns: list[str]) -> Column:
    """A row's cells that aren't null, joined by blanks."""
    return collapse(F.concat_ws(" ", *(F.col(f"`{c}`") for c in columns)))


def _cells(raw: DataFrame, log_id: str) -> DataFrame:
    frames = parse_lines(raw)
    return derive(frames.select(F.lit(log_id).alias("log_id"), "row_idx", (F.col("row_idx") + 1).alias("line_number"), *FIELDS))


def read_csv(spark: SparkSession, path: str, log_id: str = "") -> DataFrame:
    """Frames of CSV files with a header, whose cells make up lines, as parse_log() reads them; line numbers count the rows that are
    frames."""
    cells = spark.read.option("header", True).csv(path)
    return _cells(with_splits(cells, _joined(cells.columns)), log_id)


def read_excel(spark: SparkSession, path: str, log_id: str = "") -> DataFrame:
    """The same of an Excel sheet, which has at most 1,048,576 rows and is read on the driver."""
    try:
        cells = pd.read_excel(path, dtype=str)
    except ImportError as e:
        raise RuntimeError("reading Excel files needs the package openpyxl") from e
    rows = spark.createDataFrame(cells.astype(object).where(cells.notna(), None), ", ".join(f"`{c}` string" for c in cells.columns))
    places = [F.lit(path).alias("file"), *(F.lit(0).cast("long").alias(c) for c in ("split", "split_bytes", "file_bytes"))]
    return _cells(rows.coalesce(1).select(*places, _joined(list(cells.columns)).alias("line")), log_id)


def read_any(spark: SparkSession, path: str, log_id: str) -> DataFrame | None:
    """By extension; None for an unknown one. BLF and ASC files that aren't BLF are read as text."""
    kind = file_kind(path)
    if kind in ("blf", "asc") and is_blf(spark, path):
        return read_blf(spark, path, log_id)
    if kind in ("blf", "asc", "text"):
        return parse_log(spark, path, log_id)
    return {"csv": read_csv, "excel": read_excel}[kind](spark, path, log_id) if kind in ("csv", "excel") else None
