"""Text logs: line numbers across splits, a dialect per file, row numbers, derived columns."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators.decode import BROADCAST_ROWS, sized
from frameloom.operators.frames import derive
from frameloom.operators.stage import staged
from frameloom.plans.dialects import detect, framed, prepared
from frameloom.schemas import ServiceError

FIELDS = ["timestamp", "can_id", "direction", "data_len", "data", "channel"]
#: Lines at the head of a file that detection looks at first; only files without a frame there are looked at whole.
HEAD_LINES = 2_000
_FRAMES = "log_id string, row_idx long, line_number long, timestamp double, can_id long, direction int, data_len int, data binary, channel string, last_timestamp double, changed int"
_PLACE = {"file": "file_path", "split": "file_block_start", "split_bytes": "file_block_length", "file_bytes": "file_size"}


def with_splits(rows: DataFrame, line: Column) -> DataFrame:
    """file, split (where it starts), split_bytes, file_bytes and line of a scan's rows."""
    return rows.select(*(F.col(f"_metadata.{v}").alias(k) for k, v in _PLACE.items()), line.alias("line"))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Only a line feed ends a line."""
    return with_splits(spark.read.option("lineSep", "\n").text(path), F.col("value"))


def _before(per_split: DataFrame, *counts: str) -> DataFrame:
    """For a row per split: its counts replaced by their sums over the splits before, in the order of splits within each file."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in counts})


def _line_counts(raw: DataFrame) -> DataFrame:
    """(file, split, lines, low): lines in the splits before, and the first line's id; a scan that parses nothing."""
    ids = raw.select("file", "split", F.monotonically_increasing_id().alias("id"))
    return _before(ids.groupBy("file", "split").agg(F.count("*").alias("lines"), F.min("id").alias("low")), "lines")


def by_number(name: Column) -> Column:
    """A name of which numbers sort by their value: NAME_part2 before NAME_part10."""
    return F.regexp_replace(F.regexp_replace(name, "([0-9]+)", "0" * 20 + "$1"), "0*([0-9]{20,})", "$1")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (file, split, place and others) with row_idx: in the order of files, splits and places, which follow one another within a split.

    Numbers in the names of files count by their value, as the parts of a converted log do. A row per split is counted first, so that
    rows had better be staged.
    """
    per = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(by_number(F.col("file")), "file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per split
    base = per.select("file", "split", "first", before.alias("before"))
    return rows.join(sized(base), ["file", "split"]).withColumn("row_idx", F.col("before") + F.col("place") - F.col("first")).drop("place", "first", "before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, line_number (from 1), line. Lines are counted per split; no line moves."""
    raw = _raw(spark, path)
    lines = raw.select("file", "split", "line", F.monotonically_increasing_id().alias("id"))
    return lines.join(sized(_line_counts(raw)), ["file", "split"]).select("file", "split", (F.col("lines") + F.col("id") - F.col("low") + 1).alias("line_number"), "line")


def _heads(batches, lines: int):
    """The first lines of each file, of those splits that start a file.

    A split that isn't its file's last fills a task, so that the task ends as soon as its head is read; what is read of a file
    beside its head are some lines of each of its splits.
    """
    name, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column(0)
        edges = [0, *(pc.indices_nonzero(pc.not_equal(file.slice(1), file.slice(0, len(file) - 1))).to_numpy() + 1), len(file)]
        for a, b in zip(edges[:-1], edges[1:]):
            path, split, size, whole = (batch.column(k)[a].as_py() for k in range(4))
            if path != name:
                name, seen = path, 0
            if split == 0 and seen < lines:
                part = batch.slice(a, min(b - a, lines - seen))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(range(seen, seen + len(part)), pa.int64()), part.column(4)], ["file", "place", "line"])
            seen += b - a
        if split + size < whole and (split > 0 or seen >= lines):
            return


def _first_dialects(lines: DataFrame) -> DataFrame:
    """(file, dialect): that of each file's line of the least place that any dialect takes, or null. No predicate is on the parsed
    lines, as it would be pushed below with all dialects written into it once more."""
    found = detect(lines, F.col("line"))
    return found.groupBy("file").agg(F.min_by("found.dialect", F.when(F.col("found").isNotNull(), F.col("place"))).alias("dialect"))


def detect_dialects(raw: DataFrame, lines: int = HEAD_LINES) -> DataFrame:
    """(file, dialect): that of each file's first line that any dialect takes; none for files without one.

    Heads are cut first, so that the time doesn't grow with the files' lengths; only files without a frame in their heads are read whole.
    """
    heads = raw.select(*_PLACE, "line").mapInArrow(lambda batches: _heads(batches, lines), "file string, place long, line string")
    found = staged(_first_dialects(heads), "dialects")
    late = found.where("dialect IS NULL").select("file")
    if late.limit(1).count():
        rest = raw.select("file", "line", F.struct("split", F.monotonically_increasing_id().alias("id")).alias("place")).join(sized(late), "file", "left_semi")
        found = found.where("dialect IS NOT NULL").unionByName(staged(_first_dialects(rest), "dialects").where("dialect IS NOT NULL"))
    return found


def parse_lines(raw: DataFrame, dialect: str | None = None) -> DataFrame:
    """Frames of the lines of with_splits(): file, split, row_idx over all files, line_number in its file, and FIELDS.

    A first job finds each file's dialect in its head. A second one parses each line once, in a scan without a shuffle, and writes
    the frames to the shared folder, from where they are counted per split and numbered. A third scan counts lines without parsing.
    """
    spark = raw.sparkSession
    if dialect is None:
        files = detect_dialects(raw)  # a row per file
        present = [r[0] for r in files.select("dialect").distinct().orderBy("dialect").collect()]
        if files.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            raise ServiceError(f"there are more than {BROADCAST_ROWS} files; parse them in parts")
        lines = raw.join(F.broadcast(files), "file", "left")  # without moving lines
    else:
        present, lines = [dialect], raw.withColumn("dialect", F.lit(dialect))
    if not present:
        return spark.createDataFrame([], _FRAMES).select(F.lit("").alias("file"), F.lit(0).alias("split"), "row_idx", "line_number", *FIELDS)
    wide, x = prepared(lines, F.col("line"))
    wide, own = framed(wide, x, {d: F.col("dialect") == d for d in present})
    frame = F.coalesce(*own.values())
    # the id beside it keeps the predicate from being pushed below with the whole parser written into it
    parsed = wide.select("file", "split", F.monotonically_increasing_id().alias("id"), frame.alias("frame")).where("frame IS NOT NULL")
    frames = staged(parsed.select("file", "split", "id", F.monotonically_increasing_id().alias("place"), *(f"frame.{f}" for f in FIELDS)), "frames")
    rows = numbered(frames).join(sized(_line_counts(raw)), ["file", "split"])
    return rows.select("file", "split", "row_idx", (F.col("lines") + F.col("id") - F.col("low") + 1).alias("line_number"), *FIELDS)


def parse_log(spark: SparkSession, path: str, log_id: str, dialect: str | None = None, with_changed: bool = True, limit_ids: bool = True) -> DataFrame:
    """Frames of one log: row_idx in line order, last_timestamp and changed. with_changed=False leaves changed at 0."""
    rows = parse_lines(_raw(spark, path), dialect)
    out = derive(rows.select(F.lit(log_id).alias("log_id"), "row_idx", "line_number", *FIELDS), limit_ids=limit_ids)
    return out if with_changed else out.withColumn("changed", F.lit(0))


def parse_text(spark: SparkSession, text: str | None) -> DataFrame:
    """Records of a multi-line text, each line on its own; None is empty."""
    lines = spark.createDataFrame([(text or "",)], "text string").select(F.posexplode(F.split("text", "\n")).alias("line_number", "line"))
    return detect(lines, F.col("line")).where("found is not null").select((F.col("line_number") + 1).alias("line_number"), "found.dialect", "found.frame.*").orderBy("line_number")


def parse_line(spark: SparkSession, line: str):
    """The record of one line, or None."""
    rows = parse_text(spark, line).collect()
    return rows[0] if rows else None


def run_worker(spark: SparkSession, path: str, log_id: str, *_ignored, **__ignored) -> DataFrame:
    """An older name of parse_log, whose further arguments are ignored."""
    return parse_log(spark, path, log_id)


run_worker_2pass = run_worker
