"""The service: one object over a session and a folder, with jobs, statuses and events."""

from __future__ import annotations

import threading
import time
import warnings
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from frameloom.operators import decode as D
from frameloom.operators import export, index, query, stage, store
from frameloom.schemas import DecodeCode, DecodeId, DecodeStatus, InvalidFileError, LogQuery, MetadataNotFoundError, ParserStatus, RecorderState, ServiceError, new_id
from frameloom.sources import dbc, files
from frameloom.streaming import ring


@dataclass(frozen=True)
class ServiceStateEvent:
    state: str


@dataclass(frozen=True)
class ParserStatusEvent:
    log_id: str
    status: ParserStatus


@dataclass(frozen=True)
class DbcLoadedEvent:
    dbc_id: str | None
    path: str = ""


@dataclass(frozen=True)
class DecodeStartedEvent:
    decode_id: DecodeId


@dataclass(frozen=True)
class DecodeProgressEvent:
    """Percent of the tasks of a running decode that are done."""

    decode_id: DecodeId
    percent: int


@dataclass(frozen=True)
class DecodeSignalsEvent:
    """The pairs of identifier and signal that a decode has samples of, as a table that is read when asked for."""

    decode_id: DecodeId
    pairs: DataFrame


@dataclass(frozen=True)
class DecodeCompletedEvent:
    """written and changed count samples, as the write itself has seen them; a result that was there already is reused."""

    decode_id: DecodeId
    status: DecodeStatus
    code: int = 0
    written: int = 0
    changed: int = 0
    reused: bool = False


@dataclass(frozen=True)
class RecorderStatusEvent:
    log_id: str
    state: RecorderState
    frames: int = 0


#: Parses and decodes that run at a time.
PARSE_THREADS = 4
#: Seconds between two looks at a running decode.
LOOK_SECONDS = 0.25
#: Kinds of event, and the statuses that stand for some of them when subscribing.
EVENTS = (ServiceStateEvent, ParserStatusEvent, DbcLoadedEvent, DecodeStartedEvent, DecodeProgressEvent, DecodeSignalsEvent, DecodeCompletedEvent, RecorderStatusEvent)
STANDS_FOR = {ParserStatus: ParserStatusEvent, DecodeStatus: DecodeCompletedEvent, RecorderState: RecorderStatusEvent}
_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


class Engine:
    """start() and stop() frame its life; every operation needs a running engine."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.state = spark, root.rstrip("/"), "STOPPED"
        self.frames_path, self.decoded_path, self.dbc_path = (f"{self.root}/{x}" for x in ("frames", "decoded", "dbc"))
        self._heard: dict[type, list[Callable]] = defaultdict(list)
        self._log: list[tuple[float, str, str, str, str, str]] = []
        self._recording: dict = {}
        self._listening: dict[str, ring.RecorderListener] = {}
        self._decoding: set[tuple[str, str]] = set()
        self._turns: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self._pool = ThreadPoolExecutor(PARSE_THREADS)
        self.parsing: dict[str, ParserStatus] = {}

    def start(self) -> None:
        """Finish what a crash in an update has left, then take requests."""
        self._become("STARTING")
        store.recover(self.spark, self.frames_path)
        self._become("RUNNING")

    def stop(self) -> None:
        self._become("STOPPING")
        for log_id in list(self._recording):
            self.stop_recording(log_id)
        self._become("STOPPED")

    def _become(self, state: str) -> None:
        self.state = state
        self.dispatch(ServiceStateEvent(state))

    def _running(self) -> None:
        if self.state != "RUNNING":
            raise ServiceError("the engine is not running")

    def subscribe(self, kind: type, call: Callable) -> None:
        """Hear events of a kind, of the kind that a status stands for, or (object) of all kinds. Other kinds are warned of."""
        kind = STANDS_FOR.get(kind, kind)
        if kind not in EVENTS and kind is not object:
            warnings.warn(f"there are no events of the kind {kind!r}", stacklevel=2)
            return
        self._heard[kind].append(call)

    def unsubscribe(self, kind: type, call: Callable) -> None:
        kind = STANDS_FOR.get(kind, kind)
        if call in self._heard[kind]:
            self._heard[kind].remove(call)

    def unsubscribe_all(self) -> None:
        self._heard.clear()

    def dispatch(self, event) -> None:
        own = getattr(event, "decode_id", None)
        log_id, dbc_id = (own.log_id, own.dbc_id) if own else (getattr(event, "log_id", ""), getattr(event, "dbc_id", "") or "")
        state = getattr(event, "status", getattr(event, "state", getattr(event, "percent", "")))
        detail = "reused" if getattr(event, "reused", False) else str(getattr(event, "code", "") or "")
        self._log.append((time.time(), type(event).__name__, log_id, dbc_id, getattr(state, "name", str(state)), detail))
        for call in [*self._heard[type(event)], *self._heard[object]]:
            call(event)

    def events(self) -> DataFrame:
        """All events so far: time, kind, log_id, dbc_id, state, detail."""
        return self.spark.createDataFrame(self._log, "time double, kind string, log_id string, dbc_id string, state string, detail string")

    @contextmanager
    def _group(self, name: str, text: str):
        """Jobs of this thread carry the name as their group, until it ends; then what was set before counts again."""
        context = self.spark.sparkContext
        before = {key: context.getLocalProperty(key) for key in _GROUP}
        context.setJobGroup(name, text, True)
        try:
            yield
        finally:
            for key, value in before.items():
                context.setLocalProperty(key, value)

    def parse_log_file(self, path: str, log_id: str | None = None) -> str:
        """Ingest a file and index it; returns its log's id. Jobs carry the id as their group, so that request_stop can cancel them."""
        self._running()
        log_id = log_id or new_id()
        with self._group(log_id, f"parse {path}"):
            self._told(log_id, ParserStatus.STARTED)
            try:
                frames = files.read_any(self.spark, path, log_id)
                if frames is None:
                    raise InvalidFileError(f"{path}: unknown kind of file")
                store.write_frames(frames, self.frames_path)
                index.write_indexes(self.spark, self.frames_path, log_id)
            except Exception:
                self._told(log_id, ParserStatus.FAILED)
                raise
            self._told(log_id, ParserStatus.DONE)
        return log_id

    def _told(self, log_id: str, status: ParserStatus) -> None:
        self.parsing[log_id] = status
        self.dispatch(ParserStatusEvent(log_id, status))

    def request_parse_job(self, path: str) -> tuple[str, Future]:
        """parse_log_file beside the caller: the log's id and its future. PARSE_THREADS jobs run at a time."""
        self._running()
        log_id = new_id()
        return log_id, self._pool.submit(inheritable_thread_target(self.spark)(self.parse_log_file), path, log_id)

    def parse_status(self, log_id: str) -> tuple[ParserStatus | None, int, int]:
        """Status of a parse, and how many of the tasks of its stages that Spark knows are done, of how many."""
        return (self.parsing.get(log_id), *self._tasks(log_id))

    def _tasks(self, group: str) -> tuple[int, int]:
        tracker, done, tasks = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if found := tracker.getStageInfo(stage):
                    done, tasks = done + found.numCompletedTasks, tasks + found.numTasks
        return done, tasks

    def log_path(self, log_id: str) -> str:
        return f"{self.frames_path}/log_id={log_id}"

    def request_stop(self, log_id: str) -> None:
        self.spark.sparkContext.cancelJobGroup(log_id)

    def frames(self, log_id: str) -> DataFrame:
        self._running()
        if not stage.exists(self.spark, f"{self.frames_path}/log_id={log_id}"):
            raise MetadataNotFoundError(log_id)
        return store.read_frames(self.spark, self.frames_path, log_id)

    def read_page(self, log_id: str, first: int, last: int) -> DataFrame:
        return query.read_page(self.frames(log_id), first, last).orderBy("row_idx")

    def read_page_filtered(self, log_id: str, first: int, last: int, **filters) -> DataFrame:
        """By the log's indexes where there are any and the page is one of theirs, else by a scan."""
        frames, wanted = self.frames(log_id), LogQuery(**filters)
        if last - first < index.CHUNK_ROWS and index.has_indexes(self.spark, self.frames_path, log_id):
            return index.page_indexed(self.spark, self.frames_path, log_id, wanted, first, last)
        return query.read_page_filtered(frames, wanted, first, last)

    def update_entries(self, updates: DataFrame) -> bool:
        """Put updates in place. Indexes of the logs that are touched go first and are built anew, so that no page is read by old ones."""
        self._running()
        logs = [r[0] for r in updates.select(F.col("log_id").cast("string")).distinct().collect()]
        for log_id in logs:
            index.drop_indexes(self.spark, self.frames_path, log_id)
        done = store.update_entries(self.spark, self.frames_path, updates)
        for log_id in logs:
            if stage.exists(self.spark, self.log_path(log_id)):
                index.write_indexes(self.spark, self.frames_path, log_id)
        return done

    def parse_dbc_file(self, path: str) -> str | None:
        """Load a database; a failure is an event with no id, as is told to subscribers."""
        self._running()
        dbc_id = new_id()
        try:
            messages, signals = dbc.read_dbc(self.spark, path, dbc_id)
            messages.write.parquet(f"{self.dbc_path}/{dbc_id}/messages")
            signals.write.parquet(f"{self.dbc_path}/{dbc_id}/signals")
        except Exception:
            self.dispatch(DbcLoadedEvent(None, path))
            return None
        self.dispatch(DbcLoadedEvent(dbc_id, path))
        return dbc_id

    def get_dbc(self, dbc_id: str) -> tuple[DataFrame, DataFrame] | None:
        if not stage.exists(self.spark, f"{self.dbc_path}/{dbc_id}"):
            return None
        return tuple(self.spark.read.parquet(f"{self.dbc_path}/{dbc_id}/{x}") for x in ("messages", "signals"))

    def decode(self, log_id: str, dbc_id: str, again: bool = False, replace: bool = False) -> DecodeId:
        """Decode a log once per database; a finished result is used again, a request in flight isn't doubled.

        With replace a decode of the log in flight is cancelled first, whatever its database; else requests for one log wait for
        one another. A failed or cancelled decode leaves nothing.
        """
        self._running()
        own, pair = DecodeId(log_id, dbc_id), (log_id, dbc_id)
        if replace:
            self.kill_decode(log_id)
        elif pair in self._decoding:
            return own
        with self._turns[log_id], self._group(f"decode-{log_id}", f"decode {log_id} by {dbc_id}"):
            if not again and store.is_decoded(self.spark, self.decoded_path, log_id, dbc_id):
                self.dispatch(DecodeSignalsEvent(own, D.signal_pairs(self.decoded(log_id, dbc_id))))
                self.dispatch(DecodeCompletedEvent(own, DecodeStatus.DONE, reused=True))
                return own
            self._decoding.add(pair)
            self.dispatch(DecodeStartedEvent(own))
            done = threading.Event()
            looker = threading.Thread(target=self._look, args=(own, done), daemon=True)
            try:
                model = self.get_dbc(dbc_id)
                code = DecodeCode.NO_DATABASE if model is None else DecodeCode.BAD_MODEL if not model[1].limit(1).count() else None
                if code is not None:
                    self.dispatch(DecodeCompletedEvent(own, DecodeStatus.FAILED, code))
                    return own
                looker.start()
                counts = Observation()
                samples = D.decode(self.frames(log_id), model[1], once=True).observe(counts, F.count(F.lit(1)).alias("written"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))
                store.write_decoded(samples, self.decoded_path, log_id, dbc_id)
                done.set()
                looker.join()
                self.dispatch(DecodeProgressEvent(own, 100))
                self.dispatch(DecodeSignalsEvent(own, D.signal_pairs(self.decoded(log_id, dbc_id))))
                self.dispatch(DecodeCompletedEvent(own, DecodeStatus.DONE, 0, counts.get["written"], counts.get["changed"]))
            except Exception:
                store.remove_decoded(self.spark, self.decoded_path, log_id, dbc_id)
                self.dispatch(DecodeCompletedEvent(own, DecodeStatus.FAILED, DecodeCode.UNHANDLED))
                raise
            finally:
                done.set()
                self._decoding.discard(pair)
        return own

    def _look(self, own: DecodeId, done: threading.Event) -> None:
        """Tell the percent of a running decode's tasks whenever it has grown; no job of its own."""
        told = 0
        while not done.wait(LOOK_SECONDS):
            ready, tasks = self._tasks(f"decode-{own.log_id}")
            percent = min(99, 100 * ready // tasks) if tasks else 0
            if percent > told:
                told = percent
                self.dispatch(DecodeProgressEvent(own, percent))

    def decode_all(self, pairs: list[tuple[str, str]]) -> list[DecodeId]:
        """Decode pairs of log and database in their order, each once."""
        return [self.decode(*pair) for pair in dict.fromkeys(pairs)]

    def request_decode(self, log_id: str, dbc_id: str, **options) -> Future:
        """decode() beside the caller."""
        self._running()
        return self._pool.submit(inheritable_thread_target(self.spark)(self.decode), log_id, dbc_id, **options)

    def kill_decode(self, log_id: str) -> None:
        self.spark.sparkContext.cancelJobGroup(f"decode-{log_id}")

    def decoded(self, log_id: str, dbc_id: str) -> DataFrame:
        if not store.is_decoded(self.spark, self.decoded_path, log_id, dbc_id):
            raise MetadataNotFoundError(f"{log_id}:{dbc_id}")
        return self.spark.read.parquet(f"{self.decoded_path}/dbc_id={dbc_id}/log_id={log_id}")

    def discard_decoded(self, log_id: str | None = None, dbc_id: str | None = None) -> int:
        return store.remove_decoded(self.spark, self.decoded_path, log_id, dbc_id)

    def start_recording(self, source: str | DataFrame, log_id: str | None = None, starting: str = "latest", capacity: int = ring.RING_CAPACITY) -> str | None:
        """Record a stream of entries (ring.SCHEMA), or a ring on this host by its path. One recording at a time: None while
        another runs. A paused recording goes on where it was."""
        self._running()
        if any(q.isActive for q in self._recording.values()):
            return None
        log_id = log_id or new_id()
        entries = ring.ring_stream(self.spark, source, capacity, starting) if isinstance(source, str) else source
        listener = ring.RecorderListener(f"record-{log_id}", lambda state, frames: self.dispatch(RecorderStatusEvent(log_id, state, frames)))
        self.spark.streams.addListener(listener)
        self._listening[log_id] = listener
        self._recording[log_id] = ring.record(entries.withColumn("row_idx", F.col("write_idx")), f"{self.root}/recorded", f"{self.root}/checkpoints/{log_id}", log_id)
        return log_id

    def _end_recording(self, log_id: str, state: RecorderState) -> None:
        ring.stop(self._recording.pop(log_id))
        listener = self._listening.pop(log_id)
        self.spark.streams.removeListener(listener)
        self.dispatch(RecorderStatusEvent(log_id, state, listener.frames))

    def pause_recording(self, log_id: str) -> None:
        """Stop reading; start_recording with this log_id goes on from the checkpoint."""
        self._end_recording(log_id, RecorderState.PAUSED)

    def stop_recording(self, log_id: str) -> None:
        self._end_recording(log_id, RecorderState.STOPPED)

    def save_record(self, log_id: str) -> bool:
        """Make a recorded log one of the frames table."""
        return store.save_record(self.spark, f"{self.root}/recorded", self.frames_path, log_id)

    def export_csv(self, log_id: str, path: str | None = None, dbc_id: str | None = None, wanted: dict[int, list[int]] | None = None, **filters) -> str | None:
        """Export a log; with a database its message names, and its samples if the log is decoded by it."""
        model = self.get_dbc(dbc_id) if dbc_id else None
        decoded = self.decoded(log_id, dbc_id).withColumn("log_id", F.lit(log_id)) if dbc_id and store.is_decoded(self.spark, self.decoded_path, log_id, dbc_id) else None
        return export.write_log_filtered(log_id, D.message_names(self.frames(log_id), model and model[0]), LogQuery(**filters), decoded, wanted, path)


_ENGINES: dict[str, Engine] = {}


def engine(spark: SparkSession, root: str) -> Engine:
    """One engine per folder."""
    return _ENGINES.setdefault(root, Engine(spark, root))
