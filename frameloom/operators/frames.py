"""Derived columns of frames, and signal-level changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators.stage import staged
from frameloom.schemas import CAPPED_ID, CHUNK_ROWS


def with_before(rows: DataFrame, keys: list[str], columns: list[str], chunk_rows: int = CHUNK_ROWS, once: bool = False) -> DataFrame:
    """Add `before`: a struct of the columns of the row before (by row_idx) with the same keys, or null.

    Rows are dealt out by keys and chunk of chunk_rows row numbers, so that a key that holds a third of a log is many tasks'.
    What a chunk ends with is carried to the key's next one, by a small table of a row per key and chunk, which is combined before
    its shuffle and asks for the key and the columns only. Over a table that is a scan of a few columns, cheaper than any copy; with
    `once`, for rows that cost more than that (a parse, a join, a decode), the rows are staged first and evaluated once.
    """
    rows = staged(rows, "rows") if once else rows
    part = [*keys, "_chunk"]
    dealt = rows.withColumn("_chunk", F.floor(F.col("row_idx") / chunk_rows))
    own = dealt.withColumn("_own", F.lag(F.struct(*columns)).over(Window.partitionBy(*part).orderBy("row_idx")))
    ends = dealt.groupBy(*part).agg(F.max_by(F.struct(*columns), "row_idx").alias("_end"))
    carried = ends.select(*part, F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried")).where("_carried is not null")
    return own.join(carried, part, "left").withColumn("before", F.coalesce("_own", "_carried")).select(*rows.columns, "before")


def derive(frames: DataFrame, limit_ids: bool = True, chunk_rows: int = CHUNK_ROWS, once: bool = False) -> DataFrame:
    """Add last_timestamp and changed, both from the frame before of the same identifier in its log.

    The first frame of an identifier has its own timestamp and no change. With limit_ids identifiers from 8192 on always have
    their own timestamp.
    """
    rows = with_before(frames, ["log_id", "can_id"], ["timestamp", "data"], chunk_rows, once)
    last = F.coalesce("before.timestamp", "timestamp")
    return rows.select(
        *frames.columns, (F.when(F.col("can_id") >= CAPPED_ID, F.col("timestamp")).otherwise(last) if limit_ids else last).alias("last_timestamp"),
        F.coalesce((F.col("before.data") != F.col("data")).cast("int"), F.lit(0)).alias("changed"),
    )


def derive_shown(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The variant of line views: last_timestamp for all identifiers (a time of 0.0 before counts as none), last_raw_data in
    hexadecimal digits (empty at first), and changed, which is false where that is empty."""
    rows = with_before(frames, ["log_id", "can_id"], ["timestamp", "data"], chunk_rows)
    last, raw = F.nullif("before.timestamp", F.lit(0.0)), F.coalesce(F.hex("before.data"), F.lit(""))
    return rows.select(*frames.columns, F.coalesce(last, "timestamp").alias("last_timestamp"), raw.alias("last_raw_data"), ((raw != "") & (raw != F.hex("data"))).alias("changed"))


def signal_changes(decoded: DataFrame, chunk_rows: int = CHUNK_ROWS, once: bool = False) -> DataFrame:
    """Set changed where a signal's raw value differs from its sample before; the first is unchanged."""
    rows = with_before(decoded, ["log_id", "can_id", "signal_id"], ["raw_value"], chunk_rows, once)
    return rows.select(*decoded.columns, F.coalesce((F.col("before.raw_value") != F.col("raw_value")).cast("int"), F.lit(0)).alias("changed"))


def live(records: DataFrame) -> DataFrame:
    """What a recorder writes before derivation: own timestamp, no change."""
    return records.withColumns({"last_timestamp": F.col("timestamp"), "changed": F.lit(0)})
