"""The frame and signal tables on disk: append, update, copy, delete."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.operators.frames import derive
from frameloom.operators.stage import _delete, _fs, _read_text, _rename, _write_text, exists, scratch, staged  # noqa: F401
from frameloom.schemas import FRAME, ServiceError, new_id

#: Rows of a file at most.
FILE_ROWS = 1_000_000
#: Files that are swapped at a time.
SWAPS = 16


def write_frames(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by log and sorted by row, so that pages and identifiers prune row groups. A log is written by many tasks, each of
    a range of its rows."""
    frames.repartitionByRange("log_id", "row_idx").sortWithinPartitions("log_id", "row_idx").write.partitionBy("log_id").option("maxRecordsPerFile", FILE_ROWS).mode(mode).parquet(path)


def read_frames(spark: SparkSession, path: str, log_id: str | None = None) -> DataFrame:
    """The frames table or one log of it. Log ids are text, also where they look like numbers."""
    found = spark.read.parquet(path)
    fields = [f.jsonValue() | {"type": "string"} if f.name == "log_id" else f.jsonValue() for f in found.schema.fields]
    df = spark.read.schema(T.StructType.fromJson({"type": "struct", "fields": fields})).parquet(path)
    return df if log_id is None else df.where(F.col("log_id") == log_id)


def updated(frames: DataFrame, updates: DataFrame) -> DataFrame:
    """Frames with the rows of updates (log_id, row_idx and any columns of frames) put in place, derived columns anew.

    What an update holds counts, also a null. Of several updates of a row the last one does (update_order, if there is such a
    column, else the order of rows).
    """
    changes = [c for c in updates.columns if c not in ("log_id", "row_idx", "update_order")]
    rows = updates if "update_order" in updates.columns else updates.withColumn("update_order", F.monotonically_increasing_id())
    new = rows.groupBy("log_id", "row_idx").agg(F.max_by(F.struct(*changes), "update_order").alias("_new")) if changes else rows.select("log_id", "row_idx").distinct().withColumn("_new", F.lit(None))
    joined = frames.join(new, ["log_id", "row_idx"], "left")
    put = joined.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in frames.columns))
    return derive(put.drop("last_timestamp", "changed"), once=True)


def _deltas(frames: DataFrame, updates: DataFrame) -> DataFrame:
    """The rows of frames that updates change, as they are afterwards: those named, and the next ones of their identifiers, whose
    derived columns follow from them. Only frames of identifiers that an updated row has or gets take part."""
    named = frames.join(updates.select("log_id", "row_idx").distinct(), ["log_id", "row_idx"], "left_semi").select("log_id", "can_id")
    new = updates.select("log_id", F.col("can_id").cast("long").alias("can_id")).where("can_id IS NOT NULL") if "can_id" in updates.columns else named
    ids = staged(named.unionByName(new).distinct(), "updated-ids")
    # an update that gives a row another identifier needs the row among those of both
    taking = frames.join(ids, ["log_id", "can_id"], "left_semi")
    after = updated(taking, updates)
    before = taking.select("log_id", "row_idx", F.struct(*taking.columns).alias("_old"))
    same = F.struct(*(F.col(c) for c in taking.columns)).eqNullSafe(F.col("_old"))
    return after.join(before, ["log_id", "row_idx"]).where(~same).drop("_old")


def update_entries(spark: SparkSession, path: str, updates: DataFrame) -> bool:
    """Put updates in place; files that hold no row which changes stay as they are. No update: False.

    What changes is worked out from the identifiers that are touched, and staged. Each file with such a row (FILE_ROWS rows at most)
    is written anew by one task, in a folder beside the table; a journal then says which files take whose place, and they are
    swapped, with three calls of the file system a file. recover() finishes a swap that a crash has cut short.
    """
    updates = staged(updates.withColumn("log_id", F.col("log_id").cast("string")), "updates")
    if not updates.limit(1).count():
        return False
    whole = read_frames(spark, path)
    # the updates' logs prune the scan's partitions at run time
    frames = whole.join(updates.select("log_id").distinct(), "log_id", "left_semi").select(*whole.columns)
    deltas = staged(_deltas(frames, updates), "deltas")
    located = whole.select("log_id", "row_idx", F.col("_metadata.file_path").alias("_file")).join(deltas.select("log_id", "row_idx"), ["log_id", "row_idx"], "left_semi")
    files = [r[0] for r in located.select("_file").distinct().orderBy("_file").collect()]  # names of the files that change
    if not files:
        return True
    aside, numbers = f"{path.rstrip('/')}._update-{new_id()}", spark.createDataFrame(list(enumerate(files)), "_number int, _file string")
    old = read_frames(spark, path).select("*", F.col("_metadata.file_path").alias("_file")).join(numbers, "_file").drop("_file")
    put = [c for c in whole.columns if c not in ("log_id", "row_idx")]
    joined = old.join(deltas.select("log_id", "row_idx", F.struct(*put).alias("_new")), ["log_id", "row_idx"], "left")
    rows = joined.select("_number", "row_idx", *(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in put))
    put_in = rows.select("_number", *(c for c in whole.columns if c != "log_id")).repartition("_number").sortWithinPartitions("_number", "row_idx")
    # version 2: tasks move what they have written; nobody looks at this folder before the job has ended
    put_in.write.partitionBy("_number").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(aside)
    fs, parts = _fs(spark, f"{aside}/_number=*/part-*")
    made = sorted((x.getPath().toUri().toString() for x in fs.globStatus(parts)), key=_number)
    if [_number(x) for x in made] != list(range(len(files))):
        raise ServiceError(f"{aside} lacks some of {len(files)} files")
    swaps = [f"{place}\t{new}\t{place.rsplit('/', 1)[0]}/part-{k:05d}-{new_id()}.parquet" for k, (place, new) in enumerate(zip(files, made))]
    journal = f"{path.rstrip('/')}._journal-{new_id()}"
    _write_text(spark, f"{journal}.part", "\n".join(swaps))
    _rename(spark, f"{journal}.part", journal)
    _swap(spark, journal)
    return True


def _number(made: str) -> int:
    return int(made.rsplit("/", 2)[1].rsplit("=", 1)[1])


def _swap(spark: SparkSession, journal: str) -> None:
    """Do what a journal says, from wherever it was left: a line has a file, the one that takes its place and the name it gets (without
    it, the name of a hidden file behind its dot and mark). Files are swapped side by side, as a call of a file system waits."""
    fs, _ = _fs(spark, journal)
    uri, of = spark._jvm.java.net.URI, spark._jvm.org.apache.hadoop.fs.Path

    def swap(line: str) -> str | None:
        place, new, *name = line.split("\t")
        source = of(uri.create(new))
        if fs.exists(source):
            folder, hidden = new.rsplit("/", 1)
            fs.delete(of(uri.create(place)), False)
            if not fs.rename(source, of(uri.create(name[0] if name else f"{folder}/{hidden[5:]}"))):
                raise ServiceError(f"{new} can't be made visible")
        return new.rsplit("/", 2)[0] if name else None

    with ThreadPoolExecutor(SWAPS) as pool:
        asides = {aside for aside in pool.map(swap, _read_text(spark, journal).split("\n")) if aside}
    for aside in asides:
        fs.delete(of(uri.create(aside)), True)
    _delete(spark, journal)


def recover(spark: SparkSession, path: str) -> int:
    """Finish swaps of files that a crash cut short; how many updates these were."""
    fs, pattern = _fs(spark, f"{path.rstrip('/')}._journal-*")
    found = [s.getPath().toString() for s in fs.globStatus(pattern) or []]
    for journal in found:
        if journal.endswith(".part"):  # no file has been swapped yet
            _delete(spark, journal)
        else:
            _swap(spark, journal)
    return len(found)


def recorded_frames(records: DataFrame) -> DataFrame:
    """A recorded log as frames: rows numbered from 0 in the order they were written, line numbers from 1, derived columns anew.

    Numbers of recorded entries have no gap, so that the first one is all that has to be known.
    """
    first = records.groupBy("log_id").agg(F.min("row_idx").alias("_first"))  # a row per log
    rows = records.join(F.broadcast(first), "log_id").withColumn("row_idx", F.col("row_idx") - F.col("_first"))
    return derive(rows.withColumn("line_number", F.col("row_idx") + 1).select(*(c for c in FRAME.names if c not in ("last_timestamp", "changed"))))


def save_record(spark: SparkSession, source: str, target: str, log_id: str) -> bool:
    """Copy a recorded log to the frames table, with the table's columns; again is the same."""
    done = f"{target}/log_id={log_id}"
    if not exists(spark, done):
        aside = f"{target.rstrip('/')}._save-{new_id()}"
        records = read_frames(spark, source, log_id)
        write_frames(recorded_frames(records) if "line_number" not in records.columns else records, aside, "overwrite")
        _fs(spark, target)[0].mkdirs(_fs(spark, target)[1])
        _rename(spark, f"{aside}/log_id={log_id}", done)
        _delete(spark, aside)
    return True


def write_decoded(decoded: DataFrame, path: str, log_id: str, dbc_id: str) -> None:
    decoded.drop("log_id", "dbc_id").sortWithinPartitions("can_id", "signal_id", "row_idx").write.mode("overwrite").parquet(f"{path}/dbc_id={dbc_id}/log_id={log_id}")


def is_decoded(spark: SparkSession, path: str, log_id: str, dbc_id: str) -> bool:
    return exists(spark, f"{path}/dbc_id={dbc_id}/log_id={log_id}/_SUCCESS")


def remove_decoded(spark: SparkSession, path: str, log_id: str | None = None, dbc_id: str | None = None) -> int:
    """Delete decode results by database, by log, or by both; how many pairs went."""
    fs, p = _fs(spark, f"{path}/dbc_id={dbc_id or '*'}/log_id={log_id or '*'}")
    found = fs.globStatus(p) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)
