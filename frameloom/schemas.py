"""Schemas, statuses, identifiers and errors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T

# Fixed values of the log formats and of the service.
VALID_LENGTHS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64]
CAPPED_ID = 8192
CHANNEL_CHARS = 15
PAGE_SIZE = 10_000
CHUNK_ROWS = 100_000
ENTRY_BYTES = 107
RING_CAPACITY = 7812

RECORD = T.StructType([
    T.StructField("timestamp", T.DoubleType()), T.StructField("can_id", T.LongType()), T.StructField("direction", T.IntegerType()),
    T.StructField("data_len", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("channel", T.StringType()),
])
FRAME = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("row_idx", T.LongType()), T.StructField("line_number", T.LongType()), *RECORD.fields, T.StructField("last_timestamp", T.DoubleType()), T.StructField("changed", T.IntegerType())])
MESSAGE = "dbc_id string, can_id long, message_name string, msg_length int, signal_count int"
SIGNAL = "dbc_id string, can_id long, signal_id int, signal_name string, start_bit int, bit_length int, byte_order int, is_signed int, has_choices int, scale double, offset double, mux_signal int, mux_value long, value_type int, mux_ranges array<struct<low: long, high: long>>"


class ParserStatus(IntEnum):
    DONE = 0
    FAILED = 1
    STARTED = 2


class DecodeStatus(IntEnum):
    DONE = 0
    FAILED = 1


class RecorderState(IntEnum):
    WRITE_BATCH = 1
    PAUSED = 2
    WAIT_RING = 3
    STOPPED = 4


class DecodeCode(IntEnum):
    NO_DATABASE = -102
    BAD_MODEL = -103
    UNHANDLED = -199


class ServiceError(Exception):
    """Base of the service's errors."""


class WorkerSpawnError(ServiceError):
    pass


class WorkerDiedError(ServiceError):
    pass


class InvalidFileError(ServiceError):
    pass


class MetadataNotFoundError(ServiceError):
    pass


def new_id() -> str:
    return uuid.uuid4().hex


@dataclass(frozen=True)
class DecodeId:
    log_id: str
    dbc_id: str
    value: str = field(default_factory=new_id, compare=False)


@dataclass(frozen=True)
class LogQuery:
    """A conjunction of filters; what is None or empty doesn't filter."""

    can_ids: tuple[int, ...] | None = None
    channels: tuple[str, ...] | None = None
    directions: tuple[int | str, ...] | None = None
    changed_only: bool = False
    time_range: tuple[float, float] | None = None


def direction_code(value: int | str) -> int:
    """0 or 1; Rx and Tx in any case and with blanks around; other texts are errors."""
    if isinstance(value, int):
        return value
    name = value.strip().lower()
    if name not in ("rx", "tx"):
        raise ValueError(f"direction is Rx or Tx, not {value!r}")
    return int(name == "tx")
