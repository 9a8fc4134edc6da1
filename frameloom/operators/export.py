"""CSV export and text conversion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.functions.lexer import direction_name, spaced_hex
from frameloom.operators import stage
from frameloom.operators.query import apply_query
from frameloom.schemas import CHUNK_ROWS, LogQuery, new_id

# Fixed values of the export format.
HEADER = ["Time", "Channel", "CAN ID", "Message Name", "Direction", "DLC", "Data"]
BLANK_ROWS = 5


def export_rows(frames: DataFrame) -> DataFrame:
    """Frames (with message_name) as text columns, in order of their identifier's first row, then of rows."""
    # a row per identifier: Spark broadcasts it by the size that it turns out to have, or splits the join's hot keys
    firsts = frames.groupBy("log_id", "can_id").agg(F.min("row_idx").alias("group_row"))
    return frames.join(firsts, ["log_id", "can_id"]).select(
        "log_id", "group_row", "row_idx", "can_id",
        F.format_string("%.6f", "timestamp").alias("time"), "channel", F.concat(F.lit("0x"), F.hex("can_id")).alias("can_id_text"),
        F.coalesce("message_name", F.lit("")).alias("message_name"), direction_name(F.col("direction")).alias("direction"),
        F.col("data_len").cast("string").alias("dlc"), spaced_hex(F.col("data")).alias("data"),
    )


def write_flat_csv(frames: DataFrame, path: str) -> None:
    """The same rows as a plain CSV folder, written by all tasks."""
    export_rows(frames).drop("log_id", "group_row", "row_idx", "can_id").write.option("header", True).mode("overwrite").csv(path)


def _cells(values: Column) -> Column:
    """An array of texts as a line of CSV."""
    return F.array_join(F.transform(values, lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)), ",")


def csv_lines(frames: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """(log_id, group_row, row_idx, place, value): lines of the export, a block per identifier.

    A block has the header, the names of its first frame's signals, and two lines a frame: its fields and its raw values. Blank
    lines stand behind each block.
    """
    rows = export_rows(frames)
    if decoded is not None:
        one = F.map_from_entries(F.collect_list(F.struct("signal_name", F.col("raw_value").cast("string"))))  # of one frame
        rows = rows.join(decoded.groupBy("log_id", "row_idx").agg(one.alias("samples")), ["log_id", "row_idx"], "left")
    else:
        rows = rows.withColumn("samples", F.lit(None).cast("map<string,string>"))
    named = rows.groupBy("log_id", "can_id").agg(F.sort_array(F.map_keys(F.min_by(F.coalesce("samples", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), "row_idx"))).alias("names"), F.max("row_idx").alias("last_row"))
    rows = rows.join(named, ["log_id", "can_id"])  # as firsts
    fields = _cells(F.array("time", "channel", "can_id_text", "message_name", "direction", "dlc", "data"))
    values = _cells(F.transform("names", lambda n: F.coalesce(F.try_element_at("samples", n), F.lit(""))))
    none = F.array().cast("array<string>")
    head = F.when(F.col("row_idx") == F.col("group_row"), F.array(F.lit(",".join(HEADER)), _cells(F.col("names")))).otherwise(none)
    tail = F.when(F.col("row_idx") == F.col("last_row"), F.array_repeat(F.lit(""), BLANK_ROWS)).otherwise(none)
    return rows.select("log_id", "group_row", "row_idx", F.posexplode(F.concat(head, F.array(fields, values), tail)).alias("place", "value"))


def write_log_csv(key: str, frames: DataFrame, decoded: DataFrame | None = None, path: str | None = None) -> str | None:
    """Write csv_lines of one log as a folder of parts that follow one another; its path, or None if there are no frames."""
    if not frames.limit(1).count():
        return None
    path = path or f"{key}_{datetime.now():%Y%m%d_%H%M%S}.csv"
    order = ["log_id", "group_row", "row_idx", "place"]
    csv_lines(frames, decoded).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.option("lineSep", "\r\n").mode("overwrite").text(path)
    return path


def write_log_filtered(key: str, frames: DataFrame, query: LogQuery, decoded: DataFrame | None = None, wanted: dict[int, list[int]] | None = None, path: str | None = None) -> str | None:
    """write_log_csv of the frames that pass the query and, if given, have one of the wanted raw values."""
    rows = apply_query(frames, query)
    if wanted and decoded is not None:
        test = F.lit(False)
        for signal, values in wanted.items():
            test = test | ((F.col("signal_id") == signal) & F.col("raw_value").isin(*values))
        rows = rows.join(decoded.where(test).select("log_id", "row_idx"), ["log_id", "row_idx"], "left_semi")
    return write_log_csv(key, rows, decoded, path)


def _padded(text: Column, n: int) -> Column:
    """Blanks behind a text up to n characters; a longer text stays whole."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), n - F.length(text))))


def text_lines(frames: DataFrame) -> DataFrame:
    """Frames (with message_name; is_fd if there is one, else by length) as lines that the CANOE and FILTER dialects read.

    Fields have a least width and a blank behind it. Times count from the log's first that isn't zero; frames before that one
    have theirs, zero.
    """
    base = frames.where("timestamp <> 0").groupBy("log_id").agg(F.min_by(F.struct("row_idx", "timestamp"), "row_idx").alias("base"))  # a row per log
    fd = F.col("is_fd") if "is_fd" in frames.columns else F.col("data_len") > 8
    since = F.col("timestamp") - F.when(F.col("row_idx") >= F.col("base.row_idx"), F.col("base.timestamp")).otherwise(0.0)
    number = F.hex("can_id")
    line = F.concat(
        _padded(F.format_string("%.6f", F.coalesce(since, "timestamp")), 12), F.lit(" "), _padded(F.when(fd, "CANFD").otherwise("CAN"), 8), F.lit(" "),
        F.when(F.trim("channel") == "0", "1").otherwise("2"), F.lit(" "), _padded(direction_name(F.col("direction")), 3), F.lit(" "),
        F.repeat(F.lit(" "), F.greatest(F.lit(0), 10 - F.length(number))), number, F.lit("    "), _padded(F.coalesce("message_name", F.lit("NOT_FOUND")), 40), F.lit(" "),
        _padded(F.col("data_len").cast("string"), 3), F.lit(" "), spaced_hex(F.col("data")),
    )
    return frames.join(base, "log_id", "left").select("log_id", "row_idx", line.alias("value"))


def convert(frames: DataFrame, path: str, name: str = "log", max_bytes: int = 9999 << 20) -> str:
    """Write text_lines as files NAME_partN.asc of about max_bytes below path, N from 1 in row order; the last file's path.

    A file ends with the line that reaches max_bytes. Bytes are summed within each range of rows, then over the ranges.
    """
    spark = frames.sparkSession
    aside = f"{path.rstrip('/')}/_parts-{new_id()}"
    lines = text_lines(frames).withColumn("range", F.floor(F.col("row_idx") / CHUNK_ROWS)).withColumn("size", (F.octet_length("value") + 1).cast("long"))
    ranges = lines.groupBy("log_id", "range").agg(F.sum("size").alias("own"))
    earlier = ranges.select("log_id", "range", F.coalesce(F.sum("own").over(Window.orderBy("log_id", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # a row per range
    before = F.coalesce(F.sum("size").over(Window.partitionBy("log_id", "range").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = lines.join(earlier, ["log_id", "range"]).withColumn("part", (F.floor((F.col("earlier") + before) / max_bytes) + 1).cast("int"))
    parts.repartition("part").sortWithinPartitions("part", "log_id", "row_idx").select("part", "value").write.partitionBy("part").text(aside)
    fs, folder = stage._fs(spark, aside)
    last = ""
    for status in sorted((x.getPath() for x in fs.globStatus(stage._fs(spark, f"{aside}/part=*/*.txt")[1]) or []), key=lambda p: int(p.getParent().getName()[5:])):
        last = f"{path.rstrip('/')}/{name}_part{status.getParent().getName()[5:]}.asc"
        stage._delete(spark, last)
        fs.rename(status, stage._fs(spark, last)[1])
    fs.delete(folder, True)
    return last
