"""Filters, pages and lookups over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.functions.lexer import normal_channel
from frameloom.schemas import CHUNK_ROWS, PAGE_SIZE, LogQuery, direction_code


def apply_query(frames: DataFrame, query: LogQuery) -> DataFrame:
    """All filters as one conjunction, which reaches the scan where Parquet can use it."""
    out = frames
    if query.can_ids:
        out = out.where(F.col("can_id").isin(*query.can_ids))
    if query.channels:
        names = {(c or "").strip("".join(map(chr, range(33)))).lower() or "unknown" for c in query.channels}
        out = out.where(normal_channel(F.col("channel")).isin(*sorted(names)))
    if query.directions:
        out = out.where(F.col("direction").isin(*sorted({direction_code(d) for d in query.directions})))
    if query.changed_only:
        out = out.where("changed = 1")
    if query.time_range:
        out = out.where(F.col("timestamp").between(*query.time_range))
    return out


def read_page(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Rows first to last, both included: a range of row_idx, not an offset."""
    return frames.where(F.col("row_idx").between(first, last))


def page_of(rows: DataFrame, first: int, last: int, deep: int = CHUNK_ROWS) -> DataFrame:
    """Rows first to last, both included, in the order of logs and rows.

    Up to `deep` rows each task keeps last + 1 rows. Beyond, rows are counted per chunk first, and only the chunks that hold the
    page are numbered.
    """
    if last < deep:
        return rows.orderBy("log_id", "row_idx").offset(first).limit(last - first + 1)
    dealt = rows.withColumn("chunk", F.floor(F.col("row_idx") / CHUNK_ROWS))
    before = F.coalesce(F.sum("n").over(Window.orderBy("log_id", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per chunk
    held = dealt.groupBy("log_id", "chunk").agg(F.count("*").alias("n")).withColumn("before", before).where((F.col("before") <= last) & (F.col("before") + F.col("n") > first))
    number = F.col("before") + F.row_number().over(Window.partitionBy("log_id", "chunk").orderBy("row_idx")) - 1
    page = dealt.join(held.drop("n"), ["log_id", "chunk"]).withColumn("number", number).where(F.col("number").between(first, last))
    return page.select(*rows.columns).orderBy("log_id", "row_idx")


def read_page_filtered(frames: DataFrame, query: LogQuery, first: int = 0, last: int = PAGE_SIZE - 1) -> DataFrame:
    """Rows first to last, both included, of those that pass, in row order."""
    return page_of(apply_query(frames, query), first, last)


def fetch_count(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("n_frames"), (F.count("*") * 107).alias("bytes_written"))


def first_last_timestamp(frames: DataFrame) -> DataFrame:
    return frames.groupBy("log_id").agg(F.min_by("timestamp", "row_idx").alias("first_timestamp"), F.max_by("timestamp", "row_idx").alias("last_timestamp"))


def read_latest(frames: DataFrame, n: int, capacity: int) -> DataFrame:
    """The last n rows, no more than capacity, in rising order."""
    return frames.orderBy(F.desc("row_idx")).limit(min(n, capacity)).orderBy("row_idx")


def _chunk() -> Column:
    """Posting lists are cut where row_idx passes a multiple of CHUNK_ROWS, so that no cell grows with a log."""
    return F.floor(F.col("row_idx") / CHUNK_ROWS).alias("chunk")


def can_id_index(frames: DataFrame) -> DataFrame:
    """Posting lists per identifier and chunk of rows: rows, timestamps and changed rows, with their counts."""
    own = F.sort_array(F.collect_list(F.struct("row_idx", "timestamp")))  # CHUNK_ROWS at most
    lists = frames.groupBy("log_id", "can_id", _chunk()).agg(F.count("*").alias("n_rows"), F.sum("changed").alias("n_changed"), own.alias("own"), F.sort_array(F.collect_list(F.when(F.col("changed") == 1, F.col("row_idx")))).alias("changed_rows"))
    return lists.select("log_id", "can_id", "chunk", "n_rows", "n_changed", F.col("own.row_idx").alias("rows"), "changed_rows", F.col("own.timestamp").alias("timestamps"))


def channel_index(frames: DataFrame) -> DataFrame:
    """Posting lists per normalised channel and chunk of rows, with the channels' codes in order of first appearance."""
    named = frames.withColumn("channel", normal_channel(F.col("channel")))
    lists = named.groupBy("log_id", "channel", _chunk()).agg(F.count("*").alias("n_rows"), F.min("row_idx").alias("first_row"), F.sort_array(F.collect_list("row_idx")).alias("rows"))
    codes = named.groupBy("log_id", "channel").agg(F.min("row_idx").alias("first_row")).select("log_id", "channel", (F.row_number().over(Window.partitionBy("log_id").orderBy("first_row")) - 1).alias("code"))  # a row per channel
    return lists.join(codes, ["log_id", "channel"])


def direction_index(frames: DataFrame) -> DataFrame:
    """Posting lists per direction and chunk of rows."""
    return frames.groupBy("log_id", F.when(F.col("direction") == 0, 0).otherwise(1).alias("direction"), _chunk()).agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_list("row_idx")).alias("rows"))


def signal_filter_page(frames: DataFrame, decoded: DataFrame, wanted: dict[int, list[int]], match_mode: str = "or", first_line: int = 0, page_size: int = 100) -> DataFrame:
    """Frames with a signal's raw value among the wanted ones (or: of any signal; and: of each), a page in row order."""
    test = F.lit(False)
    for signal, values in wanted.items():
        test = test | ((F.col("signal_id") == signal) & F.col("raw_value").isin(*values))
    hits = decoded.where(test)
    if match_mode == "and":
        hits = hits.groupBy("log_id", "row_idx").agg(F.count_distinct("signal_id").alias("n")).where(F.col("n") == len(wanted))
    found = frames.join(hits.select("log_id", "row_idx"), ["log_id", "row_idx"], "left_semi")
    return page_of(found, first_line, first_line + page_size - 1)
