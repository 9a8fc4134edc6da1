"""Queries over frames that are projected from the events table, each with its SQL for a second engine."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import lexer as L
from frameloom.operators import decode as D
from frameloom.operators import export, frames, index, query, stage, store
from frameloom.plans.dialects import detect, parse
from frameloom.schemas import LogQuery, new_id
from frameloom.sources import dbc, files, textlog
from frameloom.streaming import ring

LOG = "events"
_KIND = "CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN ' Can3 ' WHEN 3 THEN '' ELSE 'CAN1' END"
_ID = "CASE WHEN user_id % 10 = 0 THEN 419364864 + user_id ELSE 256 + user_id END"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without derived columns: one per event."""
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        f"'{LOG}' AS log_id", "event_id AS row_idx", "event_id + 1 AS line_number", f"{us} / 1e6D AS timestamp", f"{_ID} AS can_id",
        "CAST(event_id % 2 AS INT) AS direction", "2 AS data_len", "unhex(lpad(hex(CAST(floor(value / 25) AS BIGINT)), 4, '0')) AS data", f"{_KIND} AS channel", f"{us} AS us",
    )


_BASE = f"""b AS (SELECT event_id AS row_idx, event_id + 1 AS line_number, date_diff('microsecond', TIMESTAMP '2024-01-01', ts)::BIGINT AS us,
  date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6::DOUBLE AS "timestamp", ({_ID})::BIGINT AS can_id, (event_id % 2)::INTEGER AS direction,
  2 AS data_len, lpad(printf('%X', floor(value / 25)::BIGINT), 4, '0') AS data_hex, floor(value / 25)::BIGINT AS v, {_KIND} AS channel FROM events),
 f AS (SELECT *, CASE WHEN can_id >= 8192 THEN "timestamp" ELSE coalesce(lag("timestamp") OVER w, "timestamp") END AS last_timestamp,
  coalesce((lag(data_hex) OVER w <> data_hex)::INTEGER, 0) AS changed, coalesce(nullif(lower(trim(channel)), ''), 'unknown') AS normal
  FROM b WINDOW w AS (PARTITION BY can_id ORDER BY row_idx))"""

_COLUMNS = ["row_idx", "line_number", "timestamp", "can_id", "direction", "data_len", "data_hex", "channel", "last_timestamp", "changed"]
_SHOWN = ", ".join(f'"{c}"' for c in _COLUMNS)


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.derive(base(spark, sf_dir).drop("us"))


def _show(df: DataFrame) -> DataFrame:
    return df.withColumn("data_hex", F.hex("data")).select(*_COLUMNS)


QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str | None, run) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _frames_query(name: str, change, where: str) -> None:
    _add(name, f"WITH {_BASE} SELECT {_SHOWN} FROM f {where}", lambda s, d: _show(change(full(s, d))))


def _page(name: str, q: LogQuery, first: int, last: int, where: str) -> None:
    _frames_query(name, lambda f: query.read_page_filtered(f, q, first, last), f"WHERE {where} ORDER BY row_idx LIMIT {last - first + 1} OFFSET {first}")


_add("frames_base", f'WITH {_BASE} SELECT row_idx, line_number, "timestamp", can_id, direction, data_len, data_hex, channel, normal FROM f', lambda s, d: base(s, d).select("row_idx", "line_number", "timestamp", "can_id", "direction", "data_len", F.hex("data").alias("data_hex"), "channel", L.normal_channel(F.col("channel")).alias("normal")))
_add("frames_changed", f"WITH {_BASE} SELECT row_idx, can_id, changed FROM f", lambda s, d: full(s, d).select("row_idx", "can_id", "changed"))
_add("frames_last_ts", f"WITH {_BASE} SELECT row_idx, can_id, last_timestamp FROM f", lambda s, d: full(s, d).select("row_idx", "can_id", "last_timestamp"))
_add("frames_live", f'WITH {_BASE} SELECT row_idx, "timestamp" AS last_timestamp, 0 AS changed FROM f', lambda s, d: frames.live(base(s, d)).select("row_idx", "last_timestamp", "changed"))
_add("frames_shown", f"""WITH {_BASE} SELECT row_idx, can_id, coalesce(nullif(lag("timestamp") OVER w, 0.0), "timestamp") AS last_timestamp, coalesce(lag(data_hex) OVER w, '') AS last_raw_data, coalesce(lag(data_hex) OVER w <> data_hex, false) AS changed
  FROM f WINDOW w AS (PARTITION BY can_id ORDER BY row_idx)""", lambda s, d: frames.derive_shown(base(s, d)).select("row_idx", "can_id", "last_timestamp", "last_raw_data", "changed"))
_frames_query("page_deep", lambda f: query.page_of(query.apply_query(f, LogQuery(directions=("rx",))), 100, 199, deep=0), "WHERE direction = 0 ORDER BY row_idx LIMIT 100 OFFSET 100")
_frames_query("page_read", lambda f: query.read_page(f, 100, 299), "WHERE row_idx BETWEEN 100 AND 299")
_frames_query("filter_canid", lambda f: query.apply_query(f, LogQuery(can_ids=(257, 262, 419364864))), "WHERE can_id IN (257, 262, 419364864)")
_frames_query("filter_channel", lambda f: query.apply_query(f, LogQuery(channels=("CAN3", "1", ""))), "WHERE normal IN ('can3', '1', 'unknown')")
_frames_query("filter_direction", lambda f: query.apply_query(f, LogQuery(directions=(" tx ",))), "WHERE direction = 1")
_frames_query("filter_changed", lambda f: query.apply_query(f, LogQuery(changed_only=True)), "WHERE changed = 1")
_frames_query("filter_time", lambda f: query.apply_query(f, LogQuery(time_range=(86400.0, 864000.0))), 'WHERE "timestamp" BETWEEN 86400 AND 864000')
_PAGE = LogQuery(can_ids=tuple(range(256, 300)), channels=("1", "2", "can3"), directions=("Rx", 1), changed_only=True, time_range=(0.0, 2e6))
_PAGE_WHERE = "can_id BETWEEN 256 AND 299 AND normal IN ('1', '2', 'can3') AND changed = 1 AND \"timestamp\" BETWEEN 0 AND 2e6"
_page("page_filtered", _PAGE, 10, 109, _PAGE_WHERE)
_add("idx_canid", f"""WITH {_BASE} SELECT can_id, row_idx // 100000 AS chunk, count(*) AS n_rows, sum(changed)::BIGINT AS n_changed, list(row_idx ORDER BY row_idx) AS rows,
  coalesce(list(row_idx ORDER BY row_idx) FILTER (WHERE changed = 1), []) AS changed_rows, list("timestamp" ORDER BY row_idx) AS timestamps FROM f GROUP BY can_id, chunk""", lambda s, d: query.can_id_index(full(s, d)).drop("log_id"))
_add("idx_channel", f"""WITH {_BASE}, g AS (SELECT normal AS channel, row_idx // 100000 AS chunk, count(*) AS n_rows, min(row_idx) AS first_row, list(row_idx ORDER BY row_idx) AS rows FROM f GROUP BY ALL)
  SELECT g.*, c.code FROM g JOIN (SELECT normal, (row_number() OVER (ORDER BY min(row_idx)) - 1)::INTEGER AS code FROM f GROUP BY normal) c ON g.channel = c.normal""", lambda s, d: query.channel_index(full(s, d)).drop("log_id"))
_add("idx_direction", f"WITH {_BASE} SELECT direction, row_idx // 100000 AS chunk, count(*) AS n_rows, list(row_idx ORDER BY row_idx) AS rows FROM f GROUP BY ALL", lambda s, d: query.direction_index(full(s, d)).drop("log_id"))
_add("log_metadata", f'WITH {_BASE} SELECT arg_min("timestamp", row_idx) AS first_timestamp, arg_max("timestamp", row_idx) AS last_timestamp FROM f', lambda s, d: query.first_last_timestamp(full(s, d)).drop("log_id"))
_add("fetch_count", f"WITH {_BASE} SELECT count(*) AS n_frames, count(*) * 107 AS bytes_written FROM f", lambda s, d: query.fetch_count(full(s, d)))
_frames_query("read_latest", lambda f: query.read_latest(f, 500, 7812), "ORDER BY row_idx DESC LIMIT 500")


def _text(name: str, template: str, seconds: str, channel: str, dialect: str | None, where: str = "true") -> None:
    """Render each event as a line of a dialect, parse the lines, and expect the event's values."""

    def run(s, d):
        parts = {"T": F.format_string("%d.%06d", F.floor(F.col("us") / 1000000), F.col("us") % 1000000), "MS": F.floor(F.col("us") / 1000).cast("string"), "I": F.hex("can_id"), "D": L.direction_name(F.col("direction")), "B": L.spaced_hex(F.col("data"))}
        rows = base(s, d)
        pieces = [parts[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
        lines = rows.select("row_idx", F.concat(*pieces).alias("line"))
        if dialect is None:
            return detect(lines, F.col("line"), "x").select("row_idx", "x.dialect", "x.frame.timestamp", "x.frame.can_id", "x.frame.direction", "x.frame.data_len", F.hex("x.frame.data").alias("data_hex"), "x.frame.channel")
        return parse(lines, F.col("line"), dialect, "x").select("row_idx", "x.timestamp", "x.can_id", "x.direction", "x.data_len", F.hex("x.data").alias("data_hex"), "x.channel")

    shown = f"{name[6:].upper()!r} AS dialect, " if dialect is None else ""
    _add(name, f"""WITH {_BASE} SELECT row_idx, {shown}{seconds} AS "timestamp", can_id, direction, data_len, data_hex, {channel} AS channel FROM f WHERE {where}""", run)


_SECONDS = "((us // 1000000)::DOUBLE + (us % 1000000)::DOUBLE / 1000000.0::DOUBLE)"
_STAMP = "2024-01-01 00:00:00.100 "
_text("parse_canoe", "{T} CANFD 1 {D} {I} MsgA 1 0 2 2 {B}", _SECONDS, "'1'", "CANOE")
_text("parse_canoe_full", _STAMP + "{T} 1 CANFD 2 {I} {D} MsgA 1 2 {B}", _SECONDS, "'2'", "CANOE_FULL")
_text("parse_canoe_cmp", "{T} 1 {I}x {D} d 2 {B}", _SECONDS, "'1'", "CANOE_CMP")
_text("parse_cancmd", _STAMP + "{T} 1 CAN 1 {I} {D} MsgA x 2 {B}", _SECONDS, "''", "CANCMD")
_text("parse_filter", "{T} CAN 1 {D} {I} MsgA 2 {B}", _SECONDS, "''", "FILTER")
_text("parse_cansuke", "{T} 1 {I} {D} MsgZ 2 {B}", _SECONDS, "''", "CANSUKE")
_text("parse_cancmd_t2", "{MS}\t3\t{I}\tMsgA\t2\t{B}\t{D}\tCAN\t1", "((us // 1000)::DOUBLE / 1000.0::DOUBLE)", "'3'", "CANCMD_T2")
_text("parse_cancmd_t3", "{MS} 4 {I} 2 {B} {D} CANFD 1", "((us // 1000)::DOUBLE * 0.001::DOUBLE)", "'4'", "CANCMD_T3")


def _detected(s: SparkSession, d: str) -> DataFrame:
    lines = base(s, d).select("row_idx", F.concat(F.format_string("%d.%06d", F.floor(F.col("us") / 1000000), F.col("us") % 1000000), F.when(F.col("row_idx") % 3 == 0, " CANFD 1 ").otherwise(" CAN 1 "), L.direction_name(F.col("direction")), F.lit(" "), F.hex("can_id"), F.when(F.col("row_idx") % 3 == 0, " M 1 0 2 2 ").otherwise(" M 2 "), L.spaced_hex(F.col("data"))).alias("line"))
    return detect(lines, F.col("line"), "x").groupBy("x.dialect").agg(F.count("*").alias("n"), F.sum("x.frame.can_id").alias("ids"))


_add("parse_detect", f"WITH {_BASE} SELECT CASE WHEN row_idx % 3 = 0 THEN 'CANOE' ELSE 'FILTER' END AS dialect, count(*) AS n, sum(can_id)::BIGINT AS ids FROM f GROUP BY 1", _detected)


def _signal_rows(frames_: DataFrame, specs: list[tuple]) -> DataFrame:
    """The given signals for every identifier of the frames. For each third one an older message is there too, which must lose."""
    fields = "signal_id, signal_name, start_bit, bit_length, byte_order, is_signed, scale, offset, mux_signal, mux_value".split(", ")
    rows = ", ".join("named_struct(" + ", ".join(f"'{f}', {v!r}" if v is not None else f"'{f}', CAST(NULL AS INT)" for f, v in zip(fields, spec)) + ")" for spec in specs)
    each = frames_.select("can_id").distinct().select("can_id", F.explode(F.expr("IF(can_id % 3 = 0, array(0, 1), array(1))")).alias("message_order"))
    return each.selectExpr("'d' AS dbc_id", "can_id", "message_order", f"inline(array({rows}))").selectExpr("*", "0 AS has_choices").selectExpr("* EXCEPT (start_bit, offset, mux_value)", "IF(message_order = 0, 0, start_bit) AS start_bit", "CAST(IF(message_order = 0, 99, offset) AS DOUBLE) AS offset", "CAST(mux_value AS BIGINT) AS mux_value")


_SPECS = [
    (0, "be_all", 7, 16, 1, 0, 0.5, -3.0, None, None), (1, "be_nibble", 3, 4, 1, 1, 1.0, 0.0, None, None), (2, "le_all", 0, 16, 0, 0, 2.0, 1.0, None, None),
    (3, "le_high", 12, 4, 0, 0, 0.0, 0.0, None, None), (4, "le_signed", 8, 5, 0, 1, 0.25, 10.0, None, None),
]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same five signals for every identifier of the frames."""
    return _signal_rows(base(spark, sf_dir), _SPECS)


_SIGNALS = f"""{_BASE}, p AS (SELECT *, v // 256 AS b0, v % 256 AS b1 FROM f),
 x AS (SELECT row_idx, can_id, "timestamp", unnest([
   {{'signal_id': 0, 'signal_name': 'be_all', 'raw': b0 * 256 + b1, 's': 0.5::DOUBLE, 'o': -3.0::DOUBLE}},
   {{'signal_id': 1, 'signal_name': 'be_nibble', 'raw': CASE WHEN (b0 & 15) >= 8 THEN (b0 & 15) - 16 ELSE b0 & 15 END, 's': 1.0::DOUBLE, 'o': 0.0::DOUBLE}},
   {{'signal_id': 2, 'signal_name': 'le_all', 'raw': b1 * 256 + b0, 's': 2.0::DOUBLE, 'o': 1.0::DOUBLE}},
   {{'signal_id': 3, 'signal_name': 'le_high', 'raw': b1 >> 4, 's': 1.0::DOUBLE, 'o': 0.0::DOUBLE}},
   {{'signal_id': 4, 'signal_name': 'le_signed', 'raw': CASE WHEN (b1 & 31) >= 16 THEN (b1 & 31) - 32 ELSE b1 & 31 END, 's': 0.25::DOUBLE, 'o': 10.0::DOUBLE}}]) AS g FROM p),
 y AS (SELECT row_idx, can_id, "timestamp", g.signal_id AS signal_id, g.signal_name AS signal_name, g.raw::BIGINT AS raw_value, g.raw * g.s + g.o AS phys_value FROM x),
 z AS (SELECT *, coalesce((lag(raw_value) OVER (PARTITION BY can_id, signal_id ORDER BY row_idx) <> raw_value)::INTEGER, 0) AS changed FROM y)"""


def decoded(s: SparkSession, d: str) -> DataFrame:
    """Samples of the frames, whose derived columns take no part."""
    return D.decode(base(s, d), signals(s, d))


def _decoded_query(name: str, ids: str) -> None:
    _add(name, f'WITH {_SIGNALS} SELECT row_idx, can_id, "timestamp", signal_id, signal_name, raw_value, phys_value, changed FROM z WHERE signal_id IN ({ids})', lambda s, d: decoded(s, d).where(f"signal_id IN ({ids})").drop("log_id", "dbc_id"))


_decoded_query("decode_le", "2, 3")
_decoded_query("decode_be", "0")
_decoded_query("decode_signed", "1, 4")
_decoded_query("decode_long", "0, 1, 2, 3, 4")
_add("signal_dir", f"WITH {_SIGNALS} SELECT can_id, signal_id, count(*) AS sample_count, sum(changed)::BIGINT AS changed_sample_count FROM z GROUP BY can_id, signal_id", lambda s, d: D.signal_directory(decoded(s, d)))
_add("signal_ids", f"WITH {_SIGNALS} SELECT signal_id, min(row_idx) AS first_row FROM z GROUP BY signal_id", lambda s, d: D.signal_ids(decoded(s, d)))
_add("signal_pairs", f"WITH {_SIGNALS} SELECT DISTINCT can_id, signal_id FROM z", lambda s, d: D.signal_pairs(decoded(s, d)))
_add("signal_values", f"WITH {_SIGNALS} SELECT can_id, row_idx, phys_value FROM z WHERE signal_id = 2", lambda s, d: D.signal_samples(decoded(s, d), 2).select("can_id", "row_idx", "phys_value"))
_add("signal_rawvalues", f"WITH {_SIGNALS} SELECT can_id, row_idx, raw_value FROM z WHERE signal_id = 4 AND can_id = 258", lambda s, d: D.signal_samples(decoded(s, d), 4, 258).select("can_id", "row_idx", "raw_value"))
_add("signal_changed_rows", f"WITH {_SIGNALS} SELECT can_id, row_idx FROM z WHERE signal_id = 0 AND changed = 1", lambda s, d: D.signal_samples(decoded(s, d), 0, changed_only=True).select("can_id", "row_idx"))
_add("signal_filter_page", f"WITH {_SIGNALS} SELECT {_SHOWN} FROM f WHERE row_idx IN (SELECT row_idx FROM z WHERE (signal_id = 0 AND raw_value IN (3, 4, 5)) OR (signal_id = 3 AND raw_value = 1)) ORDER BY row_idx LIMIT 100 OFFSET 5", lambda s, d: _show(query.signal_filter_page(full(s, d), decoded(s, d), {0: [3, 4, 5], 3: [1]}, "or", 5)))
_add("signal_filter_and", f"WITH {_SIGNALS} SELECT {_SHOWN} FROM f WHERE row_idx IN (SELECT row_idx FROM z WHERE signal_id = 0 AND raw_value IN (3, 4, 5)) AND row_idx IN (SELECT row_idx FROM z WHERE signal_id = 3 AND raw_value = 0) ORDER BY row_idx LIMIT 100", lambda s, d: _show(query.signal_filter_page(full(s, d), decoded(s, d), {0: [3, 4, 5], 3: [0]}, "and")))
_add("decode_progress", f"WITH {_SIGNALS} SELECT count(*) AS written, least(100.0, 100.0 * count(*) / 10000)::DOUBLE AS percent FROM z", lambda s, d: D.progress(decoded(s, d), 10000))


def _wide(s: SparkSession, d: str) -> DataFrame:
    """Frames of 64 bytes, eight times the event's time in microseconds, with signals of up to 64 bits; the last is there only if
    the one before it is 3."""
    rows = base(s, d).withColumns({"data": F.unhex(F.repeat(F.lpad(F.hex("us"), 16, "0"), 8)), "data_len": F.lit(64)})
    specs = [(0, "be64", 71, 64, 1, 0, 1.0, 0.0, None, None), (1, "be60", 67, 60, 1, 0, 0.001, 0.0, None, None), (2, "le48", 144, 48, 0, 0, 1.0, -1.0, None, None), (3, "be_odd", 501, 13, 1, 1, 1.0, 0.0, None, None), (4, "switch", 504, 2, 0, 0, 1.0, 0.0, None, None), (5, "muxed", 496, 8, 0, 1, 1.0, 0.0, 4, 3), (6, "beyond", 508, 5, 0, 0, 1.0, 0.0, None, None)]
    return D.decode(rows, _signal_rows(rows, specs)).select("row_idx", "can_id", "signal_name", "raw_value", "phys_value")


_add("decode_wide", f"""WITH {_BASE}, x AS (SELECT row_idx, can_id, us, [(us >> (8 * (7 - k))) & 255 for k in range(0, 8)] AS b FROM f),
  y AS (SELECT row_idx, can_id, us, unnest([
    {{'n': 'be64', 'raw': us, 's': 1.0::DOUBLE, 'o': 0.0::DOUBLE}}, {{'n': 'be60', 'raw': us & ((1::BIGINT << 60) - 1), 's': 0.001::DOUBLE, 'o': 0.0::DOUBLE}},
    {{'n': 'le48', 'raw': b[3] + (b[4] << 8) + (b[5] << 16) + (b[6] << 24) + (b[7] << 32) + (b[8] << 40), 's': 1.0::DOUBLE, 'o': -1.0::DOUBLE}},
    {{'n': 'be_odd', 'raw': ((us >> 1) & 8191) - CASE WHEN (us >> 1) & 4096 > 0 THEN 8192 ELSE 0 END, 's': 1.0::DOUBLE, 'o': 0.0::DOUBLE}},
    {{'n': 'switch', 'raw': us & 3, 's': 1.0::DOUBLE, 'o': 0.0::DOUBLE}},
    {{'n': 'muxed', 'raw': CASE WHEN us & 3 = 3 THEN b[7] - CASE WHEN b[7] > 127 THEN 256 ELSE 0 END END, 's': 1.0::DOUBLE, 'o': 0.0::DOUBLE}}]) AS g FROM x)
  SELECT row_idx, can_id, g.n AS signal_name, g.raw::BIGINT AS raw_value, g.raw::DOUBLE * g.s + g.o AS phys_value FROM y WHERE g.raw IS NOT NULL""", _wide)


def messages(s: SparkSession, d: str) -> DataFrame:
    """A message for all identifiers but every seventh; every fifth has another one that was loaded later."""
    each = base(s, d).select("can_id").distinct().where("can_id % 7 <> 0").selectExpr("can_id", "explode(IF(can_id % 5 = 0, array(0, 1), array(0))) AS load_order")
    return each.selectExpr("'d' AS dbc_id", "can_id", "concat(IF(load_order = 0, 'Msg', 'Alt'), can_id) AS message_name", "2 AS msg_length", "5 AS signal_count", "load_order")


_NAME = "CASE WHEN can_id % 7 = 0 THEN 'NOT_FOUND' WHEN can_id % 5 = 0 THEN 'Alt' || can_id ELSE 'Msg' || can_id END"
_add("message_names", f"WITH {_BASE} SELECT row_idx, can_id, {_NAME} AS message_name FROM f", lambda s, d: D.message_names(full(s, d), messages(s, d)).select("row_idx", "can_id", "message_name"))
_add("message_unknown", f"WITH {_BASE} SELECT row_idx, 'UNKNOW' AS message_name FROM f", lambda s, d: D.message_names(full(s, d), None).select("row_idx", "message_name"))


def _updates(s: SparkSession, d: str) -> DataFrame:
    new = base(s, d).where("row_idx % 7 = 0").select("log_id", "row_idx", F.lit(b"\xff\xff").alias("data"))
    return _show(store.updated(full(s, d), new))


_add("update_entries", f"""WITH {_BASE}, u AS (SELECT * REPLACE (CASE WHEN row_idx % 7 = 0 THEN 'FFFF' ELSE data_hex END AS data_hex) FROM f),
  n AS (SELECT * REPLACE (coalesce((lag(data_hex) OVER (PARTITION BY can_id ORDER BY row_idx) <> data_hex)::INTEGER, 0) AS changed) FROM u) SELECT {_SHOWN} FROM n""", _updates)
_HEX = "left(data_hex, 2) || ' ' || right(data_hex, 2)"
_TEXT = f"""printf('%-12s %-8s %s %-3s %10s    %-40s %-3d %s', printf('%.6f', "timestamp" - CASE WHEN row_idx >= low THEN base ELSE 0 END), 'CAN', '2', CASE WHEN direction = 0 THEN 'Rx' ELSE 'Tx' END, printf('%X', can_id), name, 2, {_HEX})"""
_ZERO = """z AS (SELECT min(row_idx) AS low, arg_min("timestamp", row_idx) AS base FROM f WHERE "timestamp" <> 0)"""
_add("blf_text", f"WITH {_BASE}, {_ZERO} SELECT row_idx, {_TEXT} AS value FROM (SELECT *, {_NAME} AS name FROM f), z", lambda s, d: export.text_lines(D.message_names(full(s, d), messages(s, d))).drop("log_id"))
_add("export_rows", f"""WITH {_BASE} SELECT min(row_idx) OVER (PARTITION BY can_id) AS group_row, row_idx, can_id, printf('%.6f', "timestamp") AS time, channel, '0x' || printf('%X', can_id) AS can_id_text,
  {_NAME} AS message_name, CASE WHEN direction = 0 THEN 'Rx' ELSE 'Tx' END AS direction, '2' AS dlc, {_HEX} AS data FROM f""", lambda s, d: export.export_rows(D.message_names(full(s, d), messages(s, d))).drop("log_id"))


# Queries that write a log, a table or a stream into the shared folder and read it back.


def _folder(s: SparkSession, tag: str) -> str:
    return f"{stage.scratch(s)}/frameloom-catalogue/{tag}-{new_id()}"


def _line(kind: str):
    """An event as a line of a dialect."""
    clock = F.format_string("%d.%06d", F.floor(F.col("us") / 1000000), F.col("us") % 1000000)
    way, data = L.direction_name(F.col("direction")), L.spaced_hex(F.col("data"))
    if kind == "CANOE":
        return F.concat(clock, F.lit(" CANFD 1 "), way, F.lit(" "), F.hex("can_id"), F.lit(" MsgA 1 0 2 2 "), data)
    return F.concat(clock, F.lit(" CAN 1 "), way, F.lit(" "), F.hex("can_id"), F.lit(" MsgA 2 "), data)


def _written_log(rows: DataFrame, path: str, kind: str) -> None:
    """Lines in row order over several files, with a comment after every tenth line."""
    lines = rows.withColumn("line", F.explode(F.when(F.col("row_idx") % 10 == 0, F.array(_line(kind), F.lit("// note"))).otherwise(F.array(_line(kind)))))
    lines.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select("line").write.text(path)


def _ingested(name: str, where: str = "true", **options) -> None:
    changed = "0" if options.get("with_changed") is False else "coalesce((lag(data_hex) OVER w <> data_hex)::INTEGER, 0)"

    def run(s, d):
        path = _folder(s, name)
        _written_log(base(s, d), path, "CANOE")
        out = textlog.parse_log(s, path, "007", **options)
        return out.select("row_idx", "log_id", "timestamp", "can_id", "direction", "data_len", F.hex("data").alias("data_hex"), "channel", "last_timestamp", "changed")

    seconds = _SECONDS
    last = 'coalesce(lag(t) OVER w, t)' if options.get("limit_ids") is False else 'CASE WHEN can_id >= 8192 THEN t ELSE coalesce(lag(t) OVER w, t) END'
    _add(name, f"""WITH {_BASE}, g AS (SELECT *, {seconds} AS t FROM f)
      SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, '007' AS log_id, t AS "timestamp", can_id, direction, data_len, data_hex, '1' AS channel, {last} AS last_timestamp, {changed} AS changed
      FROM g WINDOW w AS (PARTITION BY can_id ORDER BY row_idx)""", run)


_ingested("ingest_text")
_ingested("ingest_known_dialect", dialect="CANOE")
_ingested("ingest_unchanged", with_changed=False)
_ingested("ingest_all_ids", limit_ids=False)


def _mixed(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "mixed")
    for part, kind in ((0, "CANOE"), (1, "FILTER")):
        _written_log(base(s, d).where(f"row_idx % 2 = {part}"), f"{path}/{part}", kind)
    return textlog.parse_log(s, f"{path}/*", "m").select("row_idx", "timestamp", "can_id", F.hex("data").alias("data_hex"), "channel")


_add("ingest_folder_mixed", f"""WITH {_BASE} SELECT row_number() OVER (ORDER BY row_idx % 2, row_idx) - 1 AS row_idx, {_SECONDS} AS "timestamp", can_id, data_hex, CASE WHEN row_idx % 2 = 0 THEN '1' ELSE '' END AS channel FROM f""", _mixed)


def _numbers(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "numbers")
    base(s, d).withColumn("file", F.col("row_idx") % 3).repartition("file").sortWithinPartitions("file", "row_idx").select("file", _line("FILTER").alias("value")).write.partitionBy("file").text(path)
    return textlog.read_lines(s, f"{path}/*").select(F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("long").alias("file"), "line_number", "line")


_add("read_lines", f"""WITH {_BASE} SELECT row_idx % 3 AS file, row_number() OVER (PARTITION BY row_idx % 3 ORDER BY row_idx) AS line_number,
  printf('%d.%06d', us // 1000000, us % 1000000) || ' CAN 1 ' || CASE WHEN direction = 0 THEN 'Rx' ELSE 'Tx' END || ' ' || printf('%X', can_id) || ' MsgA 2 ' || {_HEX} AS line FROM f""", _numbers)


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "csv")
    rows = base(s, d).select("row_idx", F.split(_line("FILTER"), " ").alias("c"))
    rows.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select(*(F.get("c", F.lit(k)).alias(f"c{k}") for k in range(9))).write.option("header", True).csv(path)
    return files.read_csv(s, path, "c").select("row_idx", "timestamp", "can_id", "direction", F.hex("data").alias("data_hex"), "changed")


_add("ingest_csv", f"""WITH {_BASE} SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, {_SECONDS} AS "timestamp", can_id, direction, data_hex, changed FROM f""", _csv)


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Two logs, one of which looks like a number; one is updated in place, with a null among the updates."""
    path = _folder(s, "frames")
    each = base(s, d).drop("us").withColumn("log_id", F.when(F.col("row_idx") % 2 == 0, "007").otherwise("7"))
    store.write_frames(frames.derive(each), path)
    new = each.where("row_idx % 6 = 0").select("log_id", "row_idx", F.when(F.col("row_idx") % 12 == 0, F.lit("new")).alias("channel"))
    store.update_entries(s, path, new)
    return store.read_frames(s, path, "007").select("log_id", "row_idx", "can_id", "channel", "changed")


_add("store_roundtrip", f"""WITH {_BASE} SELECT '007' AS log_id, row_idx, can_id, CASE WHEN row_idx % 12 = 0 THEN 'new' WHEN row_idx % 6 = 0 THEN NULL ELSE channel END AS channel,
  coalesce((lag(data_hex) OVER (PARTITION BY can_id ORDER BY row_idx) <> data_hex)::INTEGER, 0) AS changed FROM f WHERE row_idx % 2 = 0""", _stored)


def _indexed(s: SparkSession, d: str) -> DataFrame:
    """The page of page_filtered, by intersecting the posting lists beside a written log."""
    path = _folder(s, "indexed")
    store.write_frames(full(s, d), path)
    index.write_indexes(s, path, LOG)
    return _show(index.page_indexed(s, path, LOG, _PAGE, 10, 109))


_add("page_indexed", f"WITH {_BASE} SELECT {_SHOWN} FROM f WHERE {_PAGE_WHERE} ORDER BY row_idx LIMIT 100 OFFSET 10", _indexed)


def _updated_in_place(s: SparkSession, d: str) -> DataFrame:
    """Every 997th row gets other bytes, a null channel, and every second of these another identifier; the log is written in files of
    1,000 rows, of which those without a change stay."""
    path = _folder(s, "in-place")
    rows = full(s, d)
    rows.repartitionByRange("log_id", "row_idx").sortWithinPartitions("log_id", "row_idx").write.partitionBy("log_id").option("maxRecordsPerFile", 1000).option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    new = base(s, d).where("row_idx % 997 = 0").selectExpr("log_id", "row_idx", "unhex('FFFF') AS data", "CAST(NULL AS STRING) AS channel", "IF(row_idx % 2 = 0, 256L + row_idx % 150, can_id) AS can_id")
    store.update_entries(s, path, new)
    return _show(store.read_frames(s, path))


_add("update_in_place", f"""WITH {_BASE}, u AS (SELECT * REPLACE (CASE WHEN row_idx % 997 = 0 THEN 'FFFF' ELSE data_hex END AS data_hex, CASE WHEN row_idx % 997 <> 0 THEN channel END AS channel,
    CASE WHEN row_idx % 1994 = 0 THEN 256 + row_idx % 150 ELSE can_id END AS can_id) FROM f),
  n AS (SELECT * REPLACE (coalesce((lag(data_hex) OVER w <> data_hex)::INTEGER, 0) AS changed, CASE WHEN can_id >= 8192 THEN "timestamp" ELSE coalesce(lag("timestamp") OVER w, "timestamp") END AS last_timestamp)
    FROM u WINDOW w AS (PARTITION BY can_id ORDER BY row_idx)) SELECT {_SHOWN} FROM n""", _updated_in_place)


def _decoded_store(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "decoded")
    store.write_decoded(decoded(s, d), path, LOG, "d")
    store.write_decoded(s.read.parquet(f"{path}/dbc_id=d/log_id={LOG}").limit(1), path, LOG, "gone")  # of what is there, not decoded again
    gone, there = store.remove_decoded(s, path, dbc_id="gone"), store.is_decoded(s, path, LOG, "d") and not store.is_decoded(s, path, LOG, "gone")
    return s.read.parquet(f"{path}/dbc_id=d/log_id={LOG}").groupBy("signal_name").agg(F.count("*").alias("n"), F.sum("raw_value").alias("total"), F.lit(gone).alias("gone"), F.lit(int(there)).alias("there"))


_add("decode_store", f"WITH {_SIGNALS} SELECT signal_name, count(*) AS n, sum(raw_value)::BIGINT AS total, 1 AS gone, 1 AS there FROM z GROUP BY signal_name", _decoded_store)


def _entries(s: SparkSession, d: str, tag: str) -> DataFrame:
    """The events as a stream of entries, some files a batch."""
    path = _folder(s, tag)
    base(s, d).selectExpr("row_idx AS write_idx", "timestamp", "can_id", "direction", "data_len", "data", "channel").repartitionByRange(4, "write_idx").write.parquet(path)
    return s.readStream.schema(ring.SCHEMA).option("maxFilesPerTrigger", 4).parquet(path)


def _recorded(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "recorded")
    rows = _entries(s, d, "entries").withColumn("row_idx", F.col("write_idx"))
    ring.record(rows, f"{path}/live", f"{path}/state", f"r{new_id()}", {"availableNow": True}).awaitTermination()
    log_id = s.read.parquet(f"{path}/live").select("log_id").first()[0]
    store.save_record(s, f"{path}/live", f"{path}/frames", log_id)
    return _show(store.read_frames(s, f"{path}/frames", log_id))


_add("record_stream", f"""WITH {_BASE}, z AS (SELECT min(row_idx) AS low FROM f) SELECT * REPLACE (row_idx - low AS row_idx, row_idx - low + 1 AS line_number) FROM (SELECT {_SHOWN}, low FROM f, z)""".replace("SELECT * REPLACE", "SELECT * EXCLUDE (low) REPLACE"), _recorded)


def _live(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "live")
    rows = _entries(s, d, "live-in").select(F.lit(LOG).alias("log_id"), F.col("write_idx").alias("row_idx"), "timestamp", "can_id", "data")
    ring.live_changes(rows).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/out").select("row_idx", "can_id", "last_timestamp", "changed")


_add("live_changes", f"WITH {_BASE} SELECT row_idx, can_id, last_timestamp, changed FROM f", _live)


#: Row numbers that an entry of live_changes_late comes late at most, those that its query waits for, and rows of a file.
_LATE, _LATENESS, _LATE_FILE = 2_000_000, 3_000_000, 1_000_000


def _late_entries(rows: DataFrame, path: str) -> None:
    """rows as files in an order of their own, in which each is less than _LATE row numbers late; a file is the next batch's."""
    placed = rows.withColumn("_at", F.col("row_idx") + F.pmod(F.xxhash64("row_idx"), F.lit(_LATE)))
    placed.repartitionByRange(max(6, rows.count() // _LATE_FILE + 1), "_at").drop("_at").write.parquet(path)
    # a stream takes files by their times, and tasks end in any order
    fs, parts = stage._fs(rows.sparkSession, f"{path}/part-*")
    found = sorted((x.getPath() for x in fs.globStatus(parts)), key=lambda p: int(p.getName().split("-")[1]))
    for k, part in enumerate(found):
        fs.setTimes(part, int(time.time() * 1000) - 1000 * (len(found) - k), -1)


def _live_late(s: SparkSession, d: str) -> DataFrame:
    """Entries in an order of their own, in batches of a file; an end mark in the last file lets all go."""
    path = _folder(s, "late")
    rows = base(s, d).select(F.lit(LOG).alias("log_id"), "row_idx", "timestamp", "can_id", "data")
    end = rows.agg(F.lit(LOG).alias("log_id"), (F.max("row_idx") + 4_000_000).alias("row_idx"), F.lit(0.0).alias("timestamp"), F.lit(None).cast("long").alias("can_id"), F.lit(None).cast("binary").alias("data"))
    _late_entries(rows, f"{path}/in")
    end.write.mode("append").parquet(f"{path}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run = ring.live_changes(stream, lateness=_LATENESS).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    ring.none_dropped(run)
    return s.read.schema(ring._LIVE).parquet(f"{path}/out").select("row_idx", "can_id", "last_timestamp", "changed")


_add("live_changes_late", f"WITH {_BASE} SELECT row_idx, can_id, last_timestamp, changed FROM f", _live_late)


def _converted(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "asc")
    export.convert(full(s, d).withColumn("message_name", F.lit("M")), path, "log", 100_000)
    return s.read.text(path).groupBy(F.regexp_extract(F.col("_metadata.file_name"), "log_part([0-9]+).asc", 1).cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))


_add("blf_parts", f"""WITH {_BASE}, {_ZERO}, l AS (SELECT row_idx, strlen({_TEXT}) + 1 AS size FROM (SELECT *, 'M' AS name FROM f), z),
  p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
  SELECT (before // 100000 + 1)::INTEGER AS part, count(*) AS n, sum(size)::BIGINT AS bytes FROM p GROUP BY 1""", _converted)


def _in_time(rows: DataFrame) -> DataFrame:
    """rows with row_idx from 0 in the order of time, those of one time in the order of their old numbers."""
    dealt = rows.repartitionByRange("us", "row_idx").sortWithinPartitions("us", "row_idx")
    placed = dealt.select(F.lit("").alias("file"), F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("place"), *rows.columns)
    return textlog.numbered(stage.staged(placed, "in-time")).select(*rows.columns)


def _read_back(s: SparkSession, d: str) -> DataFrame:
    """Every frame as a line of text with a long message name, parsed as a log again. Frames stand in the order of time, as a line
    has no sign."""
    path = _folder(s, "back")
    rows = _in_time(base(s, d))
    export.convert(rows.drop("us").withColumn("message_name", F.concat(F.lit("Message_with_a_name_of_over_forty_characters_"), "can_id")), path, "log", 200_000)
    return textlog.parse_log(s, path, "b").select("row_idx", "timestamp", "can_id", "direction", F.hex("data").alias("data_hex"))


_add("blf_read_back", f"""WITH {_BASE}, z AS (SELECT min(us) AS base FROM f WHERE us > 0), g AS (SELECT *, CASE WHEN us > 0 THEN us - base ELSE us END AS t, row_number() OVER (ORDER BY us) - 1 AS n FROM f, z)
  SELECT n AS row_idx, (t // 1000000)::DOUBLE + (t % 1000000)::DOUBLE / 1000000.0::DOUBLE AS "timestamp", can_id, direction, data_hex FROM g""", _read_back)
_add("export_lines", f"""WITH {_BASE}, g AS (SELECT *, min(row_idx) OVER (PARTITION BY can_id) AS group_row, max(row_idx) OVER (PARTITION BY can_id) AS last_row FROM f),
  l AS (SELECT group_row, row_idx, row_idx = group_row AS head, printf('%.6f', "timestamp") || ',' || channel || ',0x' || printf('%X', can_id) || ',' || {_NAME} || ',' || CASE WHEN direction = 0 THEN 'Rx' ELSE 'Tx' END || ',2,' || {_HEX} AS text, last_row FROM g)
  SELECT group_row, row_idx, (0)::INTEGER AS place, 'Time,Channel,CAN ID,Message Name,Direction,DLC,Data' AS value FROM l WHERE head UNION ALL SELECT group_row, row_idx, 1, '' FROM l WHERE head
  UNION ALL SELECT group_row, row_idx, CASE WHEN head THEN 2 ELSE 0 END, text FROM l UNION ALL SELECT group_row, row_idx, CASE WHEN head THEN 3 ELSE 1 END, '' FROM l
  UNION ALL SELECT group_row, row_idx, CASE WHEN head THEN 4 ELSE 2 END + k, '' FROM l, (SELECT unnest(range(0, 5))::INTEGER AS k) WHERE row_idx = last_row""", lambda s, d: export.csv_lines(D.message_names(full(s, d), messages(s, d))).drop("log_id"))
_add("ambiguous_ids", f"WITH {_BASE} SELECT DISTINCT can_id, 'Unresolved' AS message_name FROM f WHERE can_id % 5 = 0 AND can_id % 7 <> 0", lambda s, d: D.ambiguous_ids(messages(s, d)))
_add("pairs_differ", f"WITH {_SIGNALS}, a AS (SELECT DISTINCT can_id, signal_id FROM z) SELECT can_id, signal_id, CASE WHEN signal_id = 0 THEN 'gone' ELSE 'new' END AS side FROM a WHERE signal_id < 2", lambda s, d: D.pairs_differ(D.signal_pairs(decoded(s, d)).where("signal_id <> 0"), D.signal_pairs(decoded(s, d)).where("signal_id <> 1")))
_add("lexer_values", f"""WITH {_BASE} SELECT row_idx, [0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64][1 + greatest(0, least(15, row_idx % 20 - 2))] AS fd_length, data_hex || repeat('00', 62) AS clamped, trim(channel) || ' x' AS collapsed,
  can_id || ':' || (row_idx % 4) AS signal_key FROM f""", lambda s, d: base(s, d).select("row_idx", L.fd_length((F.col("row_idx") % 20 - 2).cast("int")).alias("fd_length"), F.hex(L.clamped(F.col("data"))).alias("clamped"), F.concat(L.collapse(F.concat("channel", F.lit("  \t "))), F.lit(" x")).alias("collapsed"), L.signal_key(F.col("can_id"), F.col("row_idx") % 4).alias("signal_key")))

def _database_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A database file with a message of six signals for every identifier of the events, written from these and read back."""
    path = _folder(s, "dbc")
    number = "IF(can_id >= 2048, can_id + 2147483648L, can_id)"
    lines = [
        "'BO_ ', n, ' Msg', can_id, ': 64 ECU'", "' SG_ Switch M : 56|8@1+ (1,0) [0|0] \"\" X'", "' SG_ Inner m1M : 48|8@1+ (1,0) [0|0] \"\" X'", "' SG_ Deep m2 : 8|16@1- (0.5,-3) [0|0] \"\" X'",
        "' SG_ Plain m', can_id % 3, ' : 7|12@0+ (2,1) [0|0] \"\" X'", "' SG_ Single : 64|32@1- (1,0) [0|0] \"\" X'", "' SG_ Double : 96|64@1- (2,0.5) [0|0] \"\" X'", "' CAT_DEF_ 1 a b;'",
        "'SIG_VALTYPE_ ', n, ' Single : 1;'", "'SIG_VALTYPE_ ', n, ' Double : 2;'", "'SG_MUL_VAL_ ', n, ' Inner Switch 1-3, 7-9;'", "'SG_MUL_VAL_ ', n, ' Deep Inner 0-99;'", "'VAL_ ', n, ' Plain 0 \"off\" 1 \"on\" ;'",
    ]
    text = base(s, d).select("can_id").distinct().selectExpr("can_id", f"{number} AS n").selectExpr("can_id", f"posexplode(array({', '.join(f'concat({x})' for x in lines)}))")
    text.coalesce(1).sortWithinPartitions("can_id", "pos").select("col").write.text(path)
    return dbc.read_dbc(s, path, "d")


def _database(s: SparkSession, d: str) -> DataFrame:
    found, own = _database_of(s, d)
    shown = own.withColumn("mux_ranges", F.to_json("mux_ranges"))
    return shown.join(found.select("can_id", "message_name", "msg_length", "signal_count"), "can_id").drop("dbc_id")


_add("parse_dbc", f"""WITH {_BASE}, m AS (SELECT DISTINCT can_id FROM f), r(signal_id, signal_name, start_bit, bit_length, byte_order, is_signed, has_choices, scale, "offset", mux_signal, mux_value, value_type, mux_ranges) AS (VALUES
  (0, 'Deep', 8, 16, 0, 1, 0, 0.5::DOUBLE, -3.0::DOUBLE, 2, 0::BIGINT, 0, '[{{"low":0,"high":99}}]'), (1, 'Double', 96, 64, 0, 1, 0, 2.0, 0.5, NULL, NULL, 2, NULL), (2, 'Inner', 48, 8, 0, 0, 0, 1.0, 0.0, 5, 1, 0, '[{{"low":1,"high":3}},{{"low":7,"high":9}}]'),
  (3, 'Plain', 7, 12, 1, 0, 1, 2.0, 1.0, 5, -1, 0, NULL), (4, 'Single', 64, 32, 0, 1, 0, 1.0, 0.0, NULL, NULL, 1, NULL), (5, 'Switch', 56, 8, 0, 0, 0, 1.0, 0.0, NULL, NULL, 0, NULL))
  SELECT can_id, 'Msg' || can_id AS message_name, 64 AS msg_length, 6 AS signal_count, r.* REPLACE (CASE WHEN signal_id = 3 THEN can_id % 3 ELSE mux_value END AS mux_value) FROM m, r""", _database)


def _decoded_database(s: SparkSession, d: str) -> DataFrame:
    """Frames of 20 bytes: seven of the event's number, a switch, its value as a number of 32 bits that is exact, and one of 64 bits."""
    value, n = "floor(value / 25)", "event_id"
    hex32 = f"lpad(hex(CAST(CASE WHEN {value} = 0 THEN 0 ELSE (127 + floor(log2({value}))) * 8388608 + ({value} / pow(2, floor(log2({value}))) - 1) * 8388608 END AS BIGINT)), 8, '0')"
    swapped = lambda h: f"concat(substr({h}, 7, 2), substr({h}, 5, 2), substr({h}, 3, 2), substr({h}, 1, 2))"
    # 1 + k / 2^20 times 2 to the (n % 40 - 20), and its sign: the bits by hand
    hex64 = f"lpad(hex(shiftleft(CAST({n} % 2 AS BIGINT), 63) | shiftleft(1003 + {n} % 40, 52) | shiftleft({n} % 1048576, 32)), 16, '0')"
    turned = f"concat({', '.join(f'substr({hex64}, {k}, 2)' for k in range(15, 0, -2))})"
    events = s.read.parquet(f"{d}/events.parquet")
    rows = events.selectExpr(
        f"'{LOG}' AS log_id", "event_id AS row_idx", "0D AS timestamp", f"{_ID} AS can_id",
        f"unhex(concat(lpad(hex({n} % 65536), 4, '0'), lpad(hex({n} * 7 % 65536), 4, '0'), '0000', lpad(hex({n} % 120), 2, '0'), lpad(hex({n} % 11), 2, '0'), {swapped(hex32)}, {turned})) AS data",
    )
    return D.decode(rows, _database_of(s, d)[1], once=True).select("row_idx", "can_id", "signal_name", "raw_value", "phys_value")


_add("decode_database", f"""WITH e AS (SELECT event_id AS n, ({_ID})::BIGINT AS can_id, floor(value / 25)::DOUBLE AS v FROM events),
  b AS (SELECT *, (n % 65536) // 256 AS b0, (n % 65536) % 256 AS b1, (n * 7 % 65536) // 256 AS b2, n % 120 AS inside, n % 11 AS switch,
    CASE WHEN n % 2 = 1 THEN -1 ELSE 1 END * (1 + (n % 1048576) / 1048576.0::DOUBLE) * pow(2.0::DOUBLE, n % 40 - 20) AS wide,
    CASE WHEN v = 0 THEN 0 ELSE (127 + floor(log2(v))) * 8388608 + (v / pow(2, floor(log2(v))) - 1) * 8388608 END::BIGINT AS bits,
    (1003 + n % 40)::BIGINT * 4503599627370496 + (n % 1048576)::BIGINT * 4294967296 AS wide_bits FROM e),
  x AS (SELECT n, can_id, switch, inside, unnest([
    {{'k': 'Switch', 'raw': switch::BIGINT, 'p': switch::DOUBLE, 'ok': true}}, {{'k': 'Inner', 'raw': inside::BIGINT, 'p': inside::DOUBLE, 'ok': switch BETWEEN 1 AND 3 OR switch BETWEEN 7 AND 9}},
    {{'k': 'Deep', 'raw': (b1 + b2 * 256 - CASE WHEN b2 > 127 THEN 65536 ELSE 0 END)::BIGINT, 'p': (b1 + b2 * 256 - CASE WHEN b2 > 127 THEN 65536 ELSE 0 END) * 0.5::DOUBLE - 3, 'ok': inside <= 99 AND (switch BETWEEN 1 AND 3 OR switch BETWEEN 7 AND 9)}},
    {{'k': 'Plain', 'raw': (b0 * 16 + b1 // 16)::BIGINT, 'p': (b0 * 16 + b1 // 16) * 2.0::DOUBLE + 1, 'ok': switch = can_id % 3}},
    {{'k': 'Single', 'raw': bits, 'p': v, 'ok': true}}, {{'k': 'Double', 'raw': wide_bits - CASE WHEN n % 2 = 1 THEN 9223372036854775807 + 1::HUGEINT ELSE 0 END, 'p': wide * 2 + 0.5, 'ok': true}}]) AS g FROM b)
  SELECT n AS row_idx, can_id, g.k AS signal_name, g.raw::BIGINT AS raw_value, g.p::DOUBLE AS phys_value FROM x WHERE g.ok""", _decoded_database)
