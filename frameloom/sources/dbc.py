"""DBC databases: messages and signals of the public text format."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from frameloom.schemas import MESSAGE, SIGNAL, InvalidFileError

_MESSAGE = re.compile(r"^\s*BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)")
_SIGNAL = re.compile(r"^\s*SG_\s+(\w+)\s*([^:]*?)\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(([^,]+),([^)]+)\)")
_CHOICES = re.compile(r"^\s*VAL_\s+(\d+)\s+(\w+)\s+\d+\s+\"")
_TYPE = re.compile(r"^\s*SIG_VALTYPE_\s+(\d+)\s+(\w+)\s*:?\s*([0-2])\s*;")
_RANGES = re.compile(r"^\s*SG_MUL_VAL_\s+(\d+)\s+(\w+)\s+(\w+)\s+([0-9,\s-]+);")


def parse_dbc(text: str):
    """(messages, signals) as lists of tuples; lines with CAT_DEF_ are passed over; signals are numbered by name within a message.

    SIG_VALTYPE_ makes a signal an IEEE number of 32 (1) or 64 bits (2). SG_MUL_VAL_ names the switch of a signal, which may itself
    have one (m2M), and the ranges of its values; without it the switch is the message's M.
    """
    messages, signals, choices, types, nested, current = {}, {}, set(), {}, {}, None
    for line in text.splitlines():
        if "CAT_DEF_" in line:
            continue
        if m := _MESSAGE.match(line):
            current = int(m[1]) & 0x1FFFFFFF
            messages[current], signals[current] = (m[2], int(m[3])), []
        elif (m := _SIGNAL.match(line)) and current is not None:
            signals[current].append((m[1], int(m[3]), int(m[4]), 1 - int(m[5]), int(m[6] == "-"), float(m[7]), float(m[8]), m[2]))
        elif m := _CHOICES.match(line):
            choices.add((int(m[1]) & 0x1FFFFFFF, m[2]))
        elif m := _TYPE.match(line):
            types[int(m[1]) & 0x1FFFFFFF, m[2]] = int(m[3])
        elif m := _RANGES.match(line):
            nested[int(m[1]) & 0x1FFFFFFF, m[2]] = m[3], [tuple(map(int, r.split("-"))) for r in re.sub(r"\s", "", m[4]).split(",")]
    if not messages:
        raise InvalidFileError("no message in the database")
    rows = []
    for can_id, own in signals.items():
        own = sorted(own)
        switch = next((k for k, s in enumerate(own) if s[7] == "M"), None)  # the signal that tells which others are there
        for k, (name, start, length, order, signed, scale, offset, mux) in enumerate(own):
            value = re.fullmatch(r"m(\d+)M?", mux)
            present, ranges = (switch, int(value[1])) if value and switch is not None else (None, None), None
            if (can_id, name) in nested:
                above, ranges = nested[can_id, name]
                present = next((i for i, s in enumerate(own) if s[0] == above), -1), ranges[0][0]
            rows.append((can_id, k, name, start, length, order, signed, int((can_id, name) in choices), scale, offset, *present, types.get((can_id, name), 0), ranges))
    return [(can_id, name, size, len(signals[can_id])) for can_id, (name, size) in messages.items()], rows


def read_dbc(spark: SparkSession, path: str, dbc_id: str) -> tuple[DataFrame, DataFrame]:
    """The messages and signals tables of a file on any store."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    messages, signals = parse_dbc(text)
    return spark.createDataFrame([(dbc_id, *m) for m in messages], MESSAGE), spark.createDataFrame([(dbc_id, *s) for s in signals], SIGNAL)
