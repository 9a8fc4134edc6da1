"""Decoding frames by a database of messages and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.functions.signals import PLACE, bits_of, physical_value, place, words
from frameloom.operators.frames import signal_changes
from frameloom.operators.stage import tuned
from frameloom.schemas import CHUNK_ROWS, ServiceError

#: Rows of a database up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Copies of a larger table.
SALTS = 16
#: Switches above a signal at most.
MUX_DEPTH = 8


def sized(table: DataFrame) -> DataFrame:
    """Broadcast a table whose size has been looked at."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table.hint("merge")


def meet(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows (with row_idx) with a table of few rows a key.

    Up to BROADCAST_ROWS the table is broadcast. A larger one is dealt out SALTS times, and rows by keys and chunk of row numbers, so
    that a key that holds a third of the rows is many tasks'.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.floor(F.col("row_idx") / CHUNK_ROWS), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def _ordered(table: DataFrame) -> DataFrame:
    """The order in which a database's rows were loaded: its load_order, else that of the rows."""
    return table if "load_order" in table.columns else table.withColumn("load_order", F.monotonically_increasing_id())


def last_signals(signals: DataFrame) -> DataFrame:
    """One row per identifier and signal: of messages that claim one identifier the last loaded counts (message_order, if there is
    one), and of repeated signals the last."""
    rows = _ordered(signals)
    if "message_order" in rows.columns:
        rows = rows.withColumn("_last", F.max("message_order").over(Window.partitionBy("can_id"))).where("message_order <=> _last").drop("_last")
    best = Window.partitionBy("can_id", "signal_id").orderBy(F.desc("load_order"))
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "load_order")


def _conditions(placed: DataFrame) -> DataFrame:
    """placed signals with _conds: for each switch up the tree of a signal where its bits are and the ranges that its value must be in.

    A signal that names a switch which isn't there has a condition without a place, which no frame meets.
    """
    bounds = F.array(F.struct(F.col("mux_value").alias("low"), F.col("mux_value").alias("high")))
    ranges = F.coalesce("mux_ranges", bounds) if "mux_ranges" in placed.columns else bounds
    own = placed.withColumn("_ranges", ranges)
    at = F.struct(*PLACE, "byte_order", "is_signed")
    parents = own.select("can_id", F.col("signal_id").alias("_next"), at.alias("_at"), F.col("mux_signal").alias("_up"), F.col("_ranges").alias("_up_ranges"), F.lit(True).alias("_there"))
    none = F.array().cast(f"array<struct<{', '.join(f'{c}:int' for c in [*PLACE, 'byte_order', 'is_signed'])}, ranges:array<struct<low:long, high:long>>>>")
    out = own.withColumn("_conds", none).withColumn("_next", F.col("mux_signal"))
    for _ in range(MUX_DEPTH):
        joined = out.join(parents, ["can_id", "_next"], "left")
        here = F.struct(*(F.col(f"_at.{c}").cast("int").alias(c) for c in [*PLACE, "byte_order", "is_signed"]), F.col("_ranges").alias("ranges"))
        conds = F.when(F.col("_next").isNull(), F.col("_conds")).otherwise(F.concat("_conds", F.array(here)))
        out = joined.withColumns({"_conds": conds, "_ranges": F.col("_up_ranges")}).withColumn("_next", F.col("_up")).select(*placed.columns, "_conds", "_ranges", "_next")
        if not out.where("_next IS NOT NULL").limit(1).count():
            return out.drop("_ranges", "_next")
    raise ServiceError(f"switches are nested more than {MUX_DEPTH} deep")


def decode(frames: DataFrame, signals: DataFrame, max_signals: int | None = None, once: bool = False) -> DataFrame:
    """A row per frame and signal of its message; frames without a message and signals beyond a frame's end give none.

    With mux_signal and mux_value (or mux_ranges) among the columns of signals, a signal is there only in frames whose signal
    mux_signal has that raw value (or one in these ranges) and is there itself. With value_type raw values stand for IEEE numbers of
    32 (1) or 64 bits (2). Where the bits are is worked out once a signal, and a frame's words once a frame, before the join. With
    `once` samples are staged, so that they are decoded once, for whoever reads all of them; a filter on signals doesn't reach below
    that.
    """
    tuned(frames.sparkSession)
    if max_signals is not None:
        signals = signals.where(F.col("signal_id") < max_signals)
    placed = place(last_signals(signals))
    muxed = {"mux_signal", "mux_value"} <= set(signals.columns)
    if muxed:
        placed = _conditions(placed)
    worded = frames.withColumns({"_words": words(F.col("data")), "_bytes": F.octet_length("data")})
    joined = meet(worded, placed, ["can_id"])
    if muxed:

        def met(c):
            value = bits_of(F.col("_words"), F.col("_bytes"), *(c[x] for x in [*PLACE, "byte_order", "is_signed"]))
            return F.coalesce(F.exists(c["ranges"], lambda r: value.between(r["low"], r["high"])), F.lit(False))

        joined = joined.where(F.when(F.size("_conds") == 0, True).otherwise(F.forall("_conds", met)))
    raw = bits_of(F.col("_words"), F.col("_bytes"), *(F.col(c) for c in [*PLACE, "byte_order", "is_signed"]))
    kind = F.col("value_type") if "value_type" in signals.columns else None
    out = joined.withColumn("raw_value", raw).where("raw_value is not null").withColumn("phys_value", physical_value(F.col("raw_value"), F.col("scale"), F.col("offset"), kind))
    return signal_changes(out.select("log_id", "dbc_id", "row_idx", "timestamp", "can_id", "signal_id", "signal_name", "raw_value", "phys_value"), once=once)


def decode_frame(frame: DataFrame, signals: DataFrame) -> DataFrame:
    """The samples of single frames (can_id, data), without a log around them."""
    rows = frame.select(F.lit("").alias("log_id"), F.monotonically_increasing_id().alias("row_idx"), F.lit(0.0).alias("timestamp"), "can_id", "data")
    return decode(rows, signals).select("can_id", "signal_id", "signal_name", "raw_value", "phys_value")


def message_names(frames: DataFrame, messages: DataFrame | None) -> DataFrame:
    """message_name: UNKNOW without a database, NOT_FOUND for identifiers that it lacks. Of messages with one identifier the last
    loaded wins."""
    if messages is None:
        return frames.withColumn("message_name", F.lit("UNKNOW"))
    names = _ordered(messages).groupBy("can_id").agg(F.max_by("message_name", "load_order").alias("message_name"))
    return meet(frames, names, ["can_id"], "left").withColumn("message_name", F.coalesce("message_name", F.lit("NOT_FOUND")))


def ambiguous_ids(messages: DataFrame) -> DataFrame:
    """Identifiers that several messages of a mixed database claim."""
    return messages.groupBy("can_id").agg(F.count("*").alias("n")).where("n > 1").select("can_id", F.lit("Unresolved").alias("message_name"))


def signal_directory(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("can_id", "signal_id").agg(F.count("*").alias("sample_count"), F.sum("changed").alias("changed_sample_count"))


def signal_ids(decoded: DataFrame) -> DataFrame:
    """Distinct signals in order of first appearance."""
    return decoded.groupBy("signal_id").agg(F.min(F.struct("row_idx", "can_id")).alias("first")).orderBy("first", "signal_id").select("signal_id", F.col("first.row_idx").alias("first_row"))


def signal_pairs(decoded: DataFrame) -> DataFrame:
    return decoded.select("can_id", "signal_id").distinct()


def pairs_differ(now: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs in one snapshot only."""
    return now.exceptAll(before).withColumn("side", F.lit("new")).unionByName(before.exceptAll(now).withColumn("side", F.lit("gone")))


def signal_samples(decoded: DataFrame, signal_id: int, can_id: int | None = None, changed_only: bool = False) -> DataFrame:
    """Samples of a signal ordered by identifier and row."""
    out = decoded.where(F.col("signal_id") == signal_id)
    if can_id is not None:
        out = out.where(F.col("can_id") == can_id)
    if changed_only:
        out = out.where("changed = 1")
    return out.select("can_id", "row_idx", "raw_value", "phys_value").orderBy("can_id", "row_idx")


def progress(decoded: DataFrame, expected: int) -> DataFrame:
    return decoded.agg(F.count("*").alias("written")).withColumn("percent", F.least(F.lit(100.0), 100.0 * F.col("written") / F.lit(max(1, expected))))
