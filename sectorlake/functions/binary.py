"""Typed reads and writes on binary columns, as column expressions.

Offsets count from 0 and may be numbers or columns.  Reads beyond the end give null.  Integers are big-endian unless
``little`` is set; unsigned 32-bit values are BIGINT, so that they never turn negative.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LATIN1 = "ISO-8859-1"
U32 = 0xFFFFFFFF


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(offset, length) -> Column:
    """A cursor position held inside [0, length - 1]."""
    return F.greatest(F.lit(0), F.least(_col(offset), _col(length) - 1))


def at_end(offset, length, margin=0) -> Column:
    """Whether a cursor position is at the end of the data, or within ``margin`` bytes of it."""
    return _col(offset) >= _col(length) - _col(margin)


def read_bytes(data: Column, offset, count) -> Column:
    return F.substring(data, _col(offset) + 1, _col(count))


def _whole(data: Column, offset, count: int) -> Column:
    part = read_bytes(data, offset, count)
    return F.when(F.octet_length(part) == count, part)


def unsigned(data: Column, offset, count: int, little: bool = False) -> Column:
    text = F.hex(_whole(data, offset, count))
    if little:
        text = F.concat(*(F.substring(text, 2 * k + 1, 2) for k in reversed(range(count))))
    return F.conv(text, 16, 10).cast("bigint")


def signed(data: Column, offset, count: int, little: bool = False) -> Column:
    value, half = unsigned(data, offset, count, little), 1 << (8 * count - 1)
    return F.when(value >= half, value - 2 * half).otherwise(value)


def u8(data: Column, offset) -> Column:
    return unsigned(data, offset, 1)


def s8(data: Column, offset) -> Column:
    return signed(data, offset, 1)


def u16(data: Column, offset, little: bool = False) -> Column:
    return unsigned(data, offset, 2, little)


def s16(data: Column, offset, little: bool = False) -> Column:
    return signed(data, offset, 2, little)


def u32(data: Column, offset, little: bool = False) -> Column:
    return unsigned(data, offset, 4, little)


def hex_parts(data: Column, size: int) -> Column:
    """Pieces of ``size`` bytes as hexadecimal text; the data is evaluated once, whatever is done with the pieces."""
    return F.regexp_extract_all(F.hex(data), F.lit(f"(.{{{2 * size}}})"), F.lit(1))


def _value(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def u32_array(data: Column, offset: int, count: int) -> Column:
    return F.transform(hex_parts(read_bytes(data, offset, 4 * count), 4), _value)


def latin1(data: Column, offset, count) -> Column:
    """Text up to the first NUL of a field of ``count`` bytes."""
    return F.substring_index(F.decode(read_bytes(data, offset, count), LATIN1), "\0", 1)


def pascal(data: Column, offset) -> Column:
    """Text with its length in the byte before it."""
    return latin1(data, _col(offset) + 1, u8(data, offset).cast("int"))


def bits(data: Column, count: int, bit_offset) -> Column:
    """``count`` (at most 8) bits from a bit position, most significant first; they may reach into the next byte."""
    at = _col(bit_offset)
    first = (at / 8).cast("int")
    window = u8(data, first) * 256 + F.coalesce(u8(data, first + 1), F.lit(0))
    return F.call_function("shiftright", window, (16 - count - at % 8).cast("int")).bitwiseAND((1 << count) - 1)


def byte_bits(value: Column) -> Column:
    """The eight bits of a byte, as text."""
    return F.lpad(F.bin(value.cast("bigint")), 8, "0")


def bits_value(text: Column) -> Column:
    return F.conv(text, 2, 10).cast("bigint")


def put(value, count: int, little: bool = False) -> Column:
    """An integer of ``count`` bytes; negative values by two's complement."""
    wrapped = F.pmod(_col(value).cast("bigint"), F.lit(1 << (8 * count)).cast("bigint"))
    text = F.lpad(F.hex(wrapped), 2 * count, "0")
    if little:
        text = F.concat(*(F.substring(text, 2 * k + 1, 2) for k in reversed(range(count))))
    return F.unhex(text)


def put_latin1(text) -> Column:
    return F.encode(_col(text), LATIN1)


def put_section(text, size: int, pad: bytes = b"\0") -> Column:
    """Text cut or padded to a field of ``size`` bytes."""
    return F.rpad(F.substring(put_latin1(text), 1, size), size, F.lit(pad))


def filled(count: int, value: int = 0) -> Column:
    return F.unhex(F.repeat(F.lit(f"{value:02X}"), count))


def checksum(data: Column, ignore: int = 20, words: int = 128) -> Column:
    """The negated 32-bit sum of a sector's words, without the word at byte ``ignore`` (-1: with all)."""
    zero = F.lit(0).cast("bigint")
    values = F.transform(hex_parts(F.substring(data, 1, 4 * words), 4), lambda x, i: F.when(i * 4 == ignore, zero).otherwise(_value(x)))
    return F.pmod(-F.aggregate(values, zero, lambda acc, x: acc + x), F.lit(U32 + 1))


def additive16(data: Column) -> Column:
    """The 16-bit sum of all bytes."""
    return F.aggregate(hex_parts(data, 1), F.lit(0).cast("bigint"), lambda acc, x: acc + _value(x)).bitwiseAND(65535)


def crc16(data: Column) -> Column:
    """CRC-16 with the reflected polynomial 0xA001 and a start of 0."""
    shift = lambda c: F.call_function("shiftright", c, F.lit(1))
    turn = lambda c, _: F.when(c.bitwiseAND(1) == 1, shift(c).bitwiseXOR(0xA001)).otherwise(shift(c))
    step = lambda acc, x: F.aggregate(F.sequence(F.lit(1), F.lit(8)), acc.bitwiseXOR(_value(x)), turn)
    return F.aggregate(hex_parts(data, 1), F.lit(0).cast("bigint"), step)


def name_hash(name: Column, slots: int = 72) -> Column:
    """The hash-table slot of a name: over its upper-case characters, h = (h * 13 + code) & 0x7ff, from h = length."""
    upper = F.upper(name)
    step = lambda acc, c: (acc * 13 + F.ascii(c)).bitwiseAND(0x7FF)
    return F.aggregate(F.regexp_extract_all(upper, F.lit("(?s)(.)"), F.lit(1)), F.length(upper).cast("bigint"), step) % slots
