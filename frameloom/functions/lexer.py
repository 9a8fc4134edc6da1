"""Column expressions for the tokens of a log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.schemas import CHANNEL_CHARS, VALID_LENGTHS

MAX_TOKENS = 256


def tokens(line: Column) -> Column:
    """Parts between bytes up to 0x20; an empty line has one empty token."""
    return F.slice(F.split(F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\x00-\x20]+"), 1, MAX_TOKENS)


def tab_columns(line: Column) -> Column:
    return F.slice(F.transform(F.split(line, "\t"), lambda c: F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), 1, 15)


def decimal(token: Column) -> Column:
    """Digits with an optional fraction, as whole part plus fraction over a power of ten; no sign or exponent; else null."""
    whole, part = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
    value = whole.cast("double") + F.when(part == "", F.lit(0.0)).otherwise(part.try_cast("double") / F.pow(F.lit(10.0), F.length(part)))
    return F.when(token.rlike(r"^[0-9]+(\.[0-9]*)?$"), value)


def unsigned(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("long"))


def can_id(token: Column) -> Column:
    """Hexadecimal, without any x after it and 0x before it, of which the last 32 bits count."""
    digits = F.regexp_replace(F.regexp_replace(token, "[xX]+$", ""), "^0[xX]", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]+$"), F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long"))


def spaced(t: Column) -> Column:
    """Tokens in lower case with one blank before, between and behind them: places are looked up in it by plain searches, which are
    much cheaper than functions over arrays."""
    return F.concat(F.lit(" "), F.lower(F.array_join(t, " ")), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def direction_index(line: Column) -> Column:
    """Place (from 0) of the first Rx or Tx in spaced tokens, or null."""
    return F.least(index_of(line, "rx"), index_of(line, "tx"))


def direction_at(t: Column, index: Column) -> Column:
    return F.when(F.lower(F.get(t, index)) == "rx", 0).when(F.lower(F.get(t, index)) == "tx", 1)


def index_of(line: Column, name: str) -> Column:
    """Place of the first token of that name in spaced tokens, or null."""
    at = F.instr(line, f" {name.lower()} ")
    return F.when(at > 0, _blanks(F.substr(line, F.lit(1), at)) - 1)


def _first(line: Column, n: Column, start: Column, pattern: str) -> Column:
    """Place of the first of n spaced tokens from start on, but the last one, where the pattern (with the blank before) matches."""
    rest = F.concat(F.lit(" "), F.call_function("substring_index", line, F.lit(" "), start - n - 1))
    at = F.regexp_instr(rest, F.lit(pattern))
    return F.when(start <= n - 2, F.when(at > 0, start + _blanks(F.substr(rest, F.lit(1), at)) - 1))


def length_index(line: Column, n: Column, start: Column) -> Column:
    """First place from start on of a valid length of one or two digits with a hexadecimal byte behind it."""
    lengths = "|".join(("0?[0-8]", *(str(v) for v in VALID_LENGTHS if v > 8)))
    return _first(line, n, start, f" (?:{lengths})(?= [0-9a-f]{{2}} )")


def digits_index(line: Column, n: Column, start: Column) -> Column:
    return _first(line, n, start, r" [0-9]+(?= [^ ])")


def valid_length(n: Column) -> Column:
    return n.isin(VALID_LENGTHS)


def payload(t: Column, index: Column, n: Column) -> Column:
    """The n bytes behind place index, or null if there are fewer or one isn't two hexadecimal digits."""
    part = F.array_join(F.slice(t, index + 2, n), " ")
    return F.when((F.length(part) == F.greatest(F.lit(0), 3 * n - 1)) & part.rlike("^(?:[0-9A-Fa-f]{2}(?: |$))*$"), F.unhex(F.replace(part, F.lit(" "), F.lit(""))))


def channel(token: Column) -> Column:
    return F.substring(F.coalesce(token, F.lit("")), 1, CHANNEL_CHARS)


def normal_channel(name: Column) -> Column:
    """Trimmed, in lower case; unknown if nothing is left."""
    plain = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.when(plain == "", "unknown").otherwise(plain)


def fd_length(code: Column) -> Column:
    """Length of a CAN FD length code; codes above 15 count as 15."""
    return F.get(F.array(*[F.lit(n) for n in VALID_LENGTHS]), F.least(F.greatest(code, F.lit(0)), F.lit(15)))


def spaced_hex(data: Column) -> Column:
    return F.regexp_replace(F.hex(data), "(..)(?=.)", "$1 ")


def clamped(data: Column, size: int = 64) -> Column:
    """Exactly `size` bytes: cut, or filled up with zeros."""
    return F.rpad(F.coalesce(data, F.lit(b"")), F.lit(size), F.lit(b"\x00"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def direction_name(code: Column) -> Column:
    return F.when(code == 0, "Rx").otherwise("Tx")


def signal_key(can: Column, signal: Column) -> Column:
    return F.concat_ws(":", can, signal)
