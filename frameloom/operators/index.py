"""Indexes beside a log, and pages by intersecting their posting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators import query, stage, store
from frameloom.schemas import CHUNK_ROWS, LogQuery, ServiceError, direction_code

#: The index tables: what lists their keys.
KINDS = {"can_id": query.can_id_index, "channel": query.channel_index, "direction": query.direction_index}


def index_path(path: str, kind: str) -> str:
    return f"{path.rstrip('/')}._index/{kind}"


def write_indexes(spark: SparkSession, path: str, log_id: str | None = None) -> None:
    """Build the indexes of one log of a frames table, or of all; those that are there are replaced.

    A list is that of a key and a chunk of rows, so that none grows with a log; lists are sorted by key and chunk, so that a look-up
    prunes row groups.
    """
    frames = store.read_frames(spark, path, log_id)
    for kind, lists in KINDS.items():
        made = lists(frames)
        out = made.repartitionByRange("log_id", kind, "chunk").sortWithinPartitions("log_id", kind, "chunk")
        # a log's partition is overwritten as a whole; those of other logs stay
        out.write.partitionBy("log_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(index_path(path, kind))


def has_indexes(spark: SparkSession, path: str, log_id: str) -> bool:
    return all(stage.exists(spark, f"{index_path(path, kind)}/log_id={log_id}") for kind in KINDS)


def drop_indexes(spark: SparkSession, path: str, log_id: str) -> None:
    for kind in KINDS:
        stage._delete(spark, f"{index_path(path, kind)}/log_id={log_id}")


def _lists(spark: SparkSession, path: str, kind: str, log_id: str, keys) -> DataFrame:
    lists = store.read_frames(spark, index_path(path, kind), log_id)
    return lists if keys is None else lists.where(F.col(kind).isin(*keys))


def _united(lists: DataFrame, rows: str = "rows") -> DataFrame:
    """(chunk, rows): the lists of several keys as one sorted list a chunk, of CHUNK_ROWS rows at most."""
    return lists.groupBy("chunk").agg(F.array_sort(F.flatten(F.collect_list(rows))).alias("rows"))


def matching_rows(spark: SparkSession, path: str, log_id: str, q: LogQuery) -> DataFrame:
    """(chunk, rows) that pass a query, from the indexes alone: per chunk the intersection of one united list a filter. Chunks
    without a row are left out.

    Identifiers, changes and times are all in the lists by identifier, whose rows, changed rows and times go together.
    """
    united = []
    if q.can_ids or q.changed_only or q.time_range or not (q.channels or q.directions):
        lists = _lists(spark, path, "can_id", log_id, sorted(set(q.can_ids)) if q.can_ids else None)
        if q.time_range:
            low, high = q.time_range
            timed = F.filter(F.arrays_zip("rows", "timestamps"), lambda x: x["timestamps"].between(low, high))
            lists = lists.withColumn("rows", F.transform(timed, lambda x: x["rows"]))
        if q.changed_only:
            lists = lists.withColumn("rows", F.array_intersect("changed_rows", "rows") if q.time_range else F.col("changed_rows"))
        united.append(_united(lists))
    if q.channels:
        names = {(c or "").strip("".join(map(chr, range(33)))).lower() or "unknown" for c in q.channels}
        united.append(_united(_lists(spark, path, "channel", log_id, sorted(names))))
    if q.directions:
        united.append(_united(_lists(spark, path, "direction", log_id, sorted({min(1, abs(direction_code(d))) for d in q.directions}))))
    out = united[0]
    for other in united[1:]:
        out = out.join(other.withColumnRenamed("rows", "_other"), "chunk").select("chunk", F.array_intersect("rows", "_other").alias("rows"))
    return out.where(F.size("rows") > 0)


def page_rows(matches: DataFrame, first: int, last: int) -> DataFrame:
    """row_idx of matches number first to last, both included: lists are counted per chunk, and only those chunks are opened that
    hold the page."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per chunk
    counted = matches.select("chunk", F.size("rows").cast("long").alias("n")).withColumn("before", before)
    held = counted.where((F.col("before") <= last) & (F.col("before") + F.col("n") > first))
    start = F.greatest(F.lit(first) - F.col("before"), F.lit(0))
    length = F.least(F.lit(last + 1) - F.col("before"), F.col("n")) - start
    return matches.join(held, "chunk").select(F.explode(F.slice("rows", (start + 1).cast("int"), length.cast("int"))).alias("row_idx"))


def page_indexed(spark: SparkSession, path: str, log_id: str, q: LogQuery, first: int = 0, last: int = CHUNK_ROWS - 1) -> DataFrame:
    """Frames first to last, both included, of those of a log that pass a query, in row order, as read_page_filtered() gives them.

    The indexes say which rows these are before a frame is read. The rows are staged, a page of at most CHUNK_ROWS; the scan of the
    frames gets the range that they span as a predicate, which prunes files and row groups, and meets them by broadcast.
    """
    if last - first >= CHUNK_ROWS:
        raise ServiceError(f"a page has {CHUNK_ROWS} rows at most")
    rows = stage.staged(page_rows(matching_rows(spark, path, log_id, q), first, last), "page")
    low, high = rows.agg(F.min("row_idx"), F.max("row_idx")).first()
    frames = store.read_frames(spark, path, log_id)
    if low is None:
        return frames.limit(0)
    return frames.where(F.col("row_idx").between(low, high)).join(F.broadcast(rows), "row_idx", "left_semi").orderBy("row_idx")
