"""Column expressions that take signals out of frame payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that place() adds to a signal.
PLACE = ["first_word", "last_byte", "right_shift", "spare_bits"]
#: Words of 32 bits in a frame of 64 bytes, and two more behind them, as a signal may span three.
WORDS = 18
#: Value types of signals: whole numbers, IEEE numbers of 32 and of 64 bits.
WHOLE, SINGLE, DOUBLE = 0, 1, 2


def place(signals: DataFrame) -> DataFrame:
    """Add what bits() needs of each signal (start_bit, bit_length, byte_order), once a signal and not once a frame.

    Order 0: Intel, start is the least significant bit. Order 1: Motorola, start is the most significant bit in sawtooth
    numbering. A signal spans three words of 32 bits at most: right_shift is counted in these as one number of 96 bits.
    """
    start, length, motorola = F.col("start_bit"), F.col("bit_length"), F.col("byte_order") == 1
    sent = F.when(motorola, 8 * F.floor(start / 8) + 7 - start % 8).otherwise(start)  # place from the first bit sent
    good = length.between(1, 64) & (start >= 0)
    return signals.withColumns({
        "first_word": F.when(good, F.floor(sent / 32)).cast("int"),
        "last_byte": F.when(good, F.floor((sent + length - 1) / 8)).cast("int"),
        "right_shift": F.when(motorola, 96 - sent % 32 - length).otherwise(start % 32).cast("int"),
        "spare_bits": (64 - length).cast("int"),
    })


def words(data: Column) -> Column:
    """A frame's bytes as words of 32 bits, the first byte the highest, with zeros behind them; worked out once a frame."""
    digits = lambda k: F.rpad(F.hex(F.substring(data, 4 * k + 1, 4)), 8, "0")
    return F.array(*(F.when(F.octet_length(data) > 4 * k, F.conv(digits(k), 16, 10).cast("long")).otherwise(0) for k in range(WORDS)))


def _left(x: Column, n) -> Column:
    return F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))


def _right(x: Column, n) -> Column:
    return F.call_function("shiftrightunsigned", x, n if isinstance(n, Column) else F.lit(n))


def _turned(word: Column) -> Column:
    """A word with its bytes the other way round."""
    return _left(word.bitwiseAND(0xFF), 24).bitwiseOR(_left(word.bitwiseAND(0xFF00), 8)).bitwiseOR(_right(word, 8).bitwiseAND(0xFF00)).bitwiseOR(_right(word, 24))


def bits_of(frame: Column, size: Column, first: Column, last: Column, shift: Column, spare: Column, order: Column, signed: Column) -> Column:
    """Bits of a signal as a long (unsigned ones of 64 bits wrap), from a frame's words and its number of bytes; null where the frame
    is too short."""
    a, b, c = (F.get(frame, first + k) for k in range(3))
    high = _left(a, 32).bitwiseOR(b)
    motorola = F.when(shift < 32, _left(high, 32 - shift).bitwiseOR(_right(c, shift))).otherwise(_right(high, shift - 32))
    low = _left(_turned(b), 32).bitwiseOR(_turned(a))
    intel = F.when(shift == 0, low).otherwise(_right(low, shift).bitwiseOR(_left(_turned(c), 64 - shift)))
    cut = _left(F.when(order == 1, motorola).otherwise(intel), spare)
    return F.when(last < size, F.when(signed == 1, F.call_function("shiftright", cut, spare)).otherwise(_right(cut, spare)))


def bits(data: Column, first: Column, last: Column, shift: Column, spare: Column, order: Column, signed: Column) -> Column:
    """bits_of() from a frame's bytes."""
    return bits_of(words(data), F.octet_length(data), first, last, shift, spare, order, signed)


def _ieee(raw: Column, exponent_bits: int, fraction_bits: int) -> Column:
    """The number that bits of an IEEE format stand for; all of these are exact in 64 bits."""
    bias, full = (1 << (exponent_bits - 1)) - 1, (1 << exponent_bits) - 1
    exponent = _right(raw, fraction_bits).bitwiseAND(full)
    fraction = raw.bitwiseAND((1 << fraction_bits) - 1).cast("double")
    one = F.lit(1.0) + fraction / F.lit(float(1 << fraction_bits))
    size = (
        F.when((exponent == full) & (fraction == 0), F.lit(float("inf"))).when(exponent == full, F.lit(float("nan")))
        .when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(float(1 - bias - fraction_bits)))).otherwise(one * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
    )
    return F.when(_right(raw, exponent_bits + fraction_bits).bitwiseAND(1) == 1, -size).otherwise(size)


def number(raw: Column, kind: Column | None) -> Column:
    """A raw value as a number, by its value type."""
    if kind is None:
        return raw.cast("double")
    return F.when(kind == SINGLE, _ieee(raw, 8, 23)).when(kind == DOUBLE, _ieee(raw, 11, 52)).otherwise(raw.cast("double"))


def physical_value(raw: Column, scale: Column, offset: Column, kind: Column | None = None) -> Column:
    """raw * scale + offset; a missing or zero scale is 1, a missing offset 0."""
    return number(raw, kind) * F.coalesce(F.nullif(scale, F.lit(0.0)), F.lit(1.0)) + F.coalesce(offset, F.lit(0.0))
