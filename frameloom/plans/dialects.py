"""The eight text dialects as nullable structs of columns, and their detection.

Whatever several fields or dialects look up in a line (its tokens, the places of direction and length) is a column of an earlier
projection, so that it is computed once a line and plans stay small.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import lexer as L
from frameloom.operators.stage import tuned


class Line(NamedTuple):
    """A line, its tokens, and the places (from 0) in it: of the direction, of CANFD, and of the lengths that dialects search for."""

    text: Column
    tokens: Column
    spaced: Column
    way: Column
    fd: Column
    after1: Column
    after2: Column
    from3: Column
    digits: Column


_LINE = "_line_{}"


def prepared(df: DataFrame, line: Column) -> tuple[DataFrame, Line]:
    """df with the columns of a Line added; those a plan doesn't use are pruned."""
    tuned(df.sparkSession)
    c = Line(*[F.col(_LINE.format(f)) for f in Line._fields])
    n = F.size(c.tokens)
    stages = [
        {"text": F.regexp_replace(line, r"[\r\n]+$", "")},
        {"tokens": L.tokens(c.text)},
        {"spaced": L.spaced(c.tokens)},
        {"way": L.direction_index(c.spaced), "fd": L.index_of(c.spaced, "CANFD")},
        {"after1": L.length_index(c.spaced, n, c.way + 1), "after2": L.length_index(c.spaced, n, c.way + 2), "from3": L.length_index(c.spaced, n, F.lit(3)), "digits": L.digits_index(c.spaced, n, c.way + 1)},
    ]
    for stage in stages:
        df = df.withColumns({_LINE.format(k): v for k, v in stage.items()})
    return df, c


class Parts(NamedTuple):
    """The fields that a dialect sees in a line, and whether the rest of the line suits it."""

    good: Column
    timestamp: Column
    can_id: Column
    direction: Column
    data_len: Column
    data: Column
    channel: Column


def _searched(x: Line, least: int, timestamp: Column, id_step: int, place: Column, channel: Column | None, good: Column | None = None) -> Parts:
    """Dialects that look for the direction and then for a length; the step to the identifier is counted from the direction."""
    t = x.tokens
    n = F.get(t, place).try_cast("int")
    ok = F.size(t) >= least
    return Parts(ok if good is None else ok & good, timestamp, L.can_id(F.get(t, x.way + id_step)), L.direction_at(t, x.way), n, L.payload(t, place, n), F.lit("") if channel is None else channel)


def canoe(x: Line) -> Parts:
    t, fd = x.tokens, x.fd
    return _searched(x, 8, L.decimal(F.get(t, F.lit(0))), 1, x.after2, L.channel(F.get(t, fd + 1)), fd.isNotNull() & (fd + 1 < F.size(t)))


def canoe_full(x: Line) -> Parts:
    t, fd = x.tokens, x.fd
    return _searched(x, 10, L.decimal(F.get(t, F.lit(2))), -1, x.after1, L.channel(F.get(t, fd + 1)), F.get(t, F.lit(0)).contains("-") & fd.isNotNull() & (fd + 1 < F.size(t)) & (x.way >= 1))


def canoe_compact(x: Line) -> Parts:
    t = x.tokens
    n = L.unsigned(F.get(t, F.lit(5))).cast("int")
    return Parts((F.size(t) >= 7) & (F.lower(F.get(t, F.lit(4))) == "d"), L.decimal(F.get(t, F.lit(0))), L.can_id(F.get(t, F.lit(2))), L.direction_at(t, F.lit(3)), n, F.when(L.valid_length(n), L.payload(t, F.lit(5), n)), L.channel(F.get(t, F.lit(1))))


def cancmd(x: Line) -> Parts:
    t = x.tokens
    return _searched(x, 10, L.decimal(F.get(t, F.lit(2))), -1, x.after1, None, F.get(t, F.lit(0)).contains("-") & (x.way >= 1))


def filtered(x: Line) -> Parts:
    t = x.tokens
    return _searched(x, 7, L.decimal(F.get(t, F.lit(0))), 1, x.after2, None)


def cansuke(x: Line) -> Parts:
    t = x.tokens
    at, place = x.way, x.digits
    n = L.unsigned(F.get(t, place)).cast("int")
    return Parts((F.size(t) >= 6) & (at >= 1), L.decimal(F.get(t, F.lit(0))), L.can_id(F.get(t, at - 1)), L.direction_at(t, at), n, F.when(L.valid_length(n), L.payload(t, place, n)), F.lit(""))


def cancmd_tab(x: Line) -> Parts:
    c = L.tab_columns(x.text)
    clock, code = F.get(c, F.lit(0)), F.get(c, F.lit(4))
    timestamp = F.when(clock.rlike("^[0-9]*$"), F.when(clock == "", 0.0).otherwise(clock.try_cast("double") / 1000.0)).otherwise(L.decimal(clock))
    letters = F.map_from_arrays(F.array(*[F.lit(x) for x in "ABCDEF"]), F.array(*[F.lit(x) for x in (16, 20, 24, 32, 48, 64)]))
    said = F.when(F.length(code) == 1, F.coalesce(F.when(code.rlike("^[0-9]$"), code.try_cast("int")), F.try_element_at(letters, F.upper(code)))).otherwise(L.unsigned(code).cast("int"))
    t = L.tokens(F.get(c, F.lit(5)))
    t = F.when(F.get(t, F.lit(0)) == "", F.array().cast("array<string>")).otherwise(t)
    n = F.least(said, F.size(t))
    data = F.when(F.array_join(F.slice(t, 1, n), " ").rlike("^([0-9A-Fa-f]{2}( |$))*$"), F.unhex(F.array_join(F.slice(t, 1, n), "")))
    way = F.lower(F.substring(F.get(c, F.lit(6)), 1, 2))
    return Parts((F.size(c) >= 7) & L.valid_length(said), timestamp, L.can_id(F.get(c, F.lit(2))), F.when(way == "rx", 0).when(way == "tx", 1), n, data, L.channel(F.get(c, F.lit(1))))


def cancmd_clock(x: Line) -> Parts:
    t = x.tokens
    at, place = x.way, x.from3
    n = F.get(t, place).try_cast("int")
    return Parts((F.size(t) >= 6) & (place < at), L.unsigned(F.get(t, F.lit(0))) * 0.001, L.can_id(F.get(t, F.lit(2))), L.direction_at(t, at), n, L.payload(t, place, n), L.channel(F.get(t, F.lit(1))))


#: In the order of detection.
DIALECTS: dict[str, Callable[[Line], Parts]] = {
    "CANCMD_T2": cancmd_tab, "CANOE": canoe, "CANOE_FULL": canoe_full, "CANOE_CMP": canoe_compact,
    "CANCMD": cancmd, "FILTER": filtered, "CANSUKE": cansuke, "CANCMD_T3": cancmd_clock,
}
#: Dialects that take any length that they found; the others take valid ones only.
_ANY_LENGTH = ("CANCMD_T2",)


def register(name: str, parser: Callable[[Line], Parts]) -> None:
    """Add a dialect of one's own, tried after the others."""
    DIALECTS[name] = parser


def framed(df: DataFrame, x: Line, guards: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """df (of prepared()) with the parts of each dialect for the lines that its guard lets in, and each one's frame or null.

    The parts are columns of a projection of their own, so that the test whether a frame is complete doesn't compute them again.
    """
    columns, frames = {}, {}
    for name, guard in guards.items():
        parts = DIALECTS[name](x)
        columns |= {_LINE.format(f"{name}_{field}"): F.when(guard, part) for field, part in zip(Parts._fields, parts)}
        own = Parts(*[F.col(_LINE.format(f"{name}_{field}")) for field in Parts._fields])
        complete = own.good & own.timestamp.isNotNull() & own.can_id.isNotNull() & own.direction.isNotNull() & own.data.isNotNull()
        if name not in _ANY_LENGTH:
            complete = complete & L.valid_length(own.data_len)
        fields = F.struct(*(part.cast("int").alias(f) if f in ("direction", "data_len") else part.alias(f) for f, part in list(own._asdict().items())[1:]))
        frames[name] = F.when(F.coalesce(complete, F.lit(False)), fields)
    return df.withColumns(columns), frames


def skipped(line: Column) -> Column:
    """Blank and comment lines, which detection passes over."""
    return line.rlike(r"^[\x00-\x20]*$|^[\x00-\x20]*[/#;]")


def parse(df: DataFrame, line: Column, dialect: str, into: str = "frame") -> DataFrame:
    """df with column `into`: the line's frame in that dialect, or null."""
    wide, x = prepared(df, line)
    wide, frames = framed(wide, x, {dialect: F.lit(True)})
    return wide.withColumn(into, frames[dialect]).select(*df.columns, into)


def detect(df: DataFrame, line: Column, into: str = "found") -> DataFrame:
    """df with column `into`: struct (dialect, frame) of the first dialect that takes the line, or null."""
    wide, x = prepared(df, line)
    able = {name: (x.text.contains("\t") if name == "CANCMD_T2" else F.size(x.tokens) >= 4) & ~skipped(x.text) for name in DIALECTS}
    wide, frames = framed(wide, x, able)
    wide = wide.withColumns({_LINE.format(name): frame for name, frame in frames.items()})
    found = F.coalesce(*[F.when(F.col(_LINE.format(name)).isNotNull(), F.struct(F.lit(name).alias("dialect"), F.col(_LINE.format(name)).alias("frame"))) for name in frames])
    return wide.withColumn(into, found).select(*df.columns, into)
