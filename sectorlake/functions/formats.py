"""How sizes, dates and bytes are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "1978-01-01"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _step(size: Column) -> Column:
    return F.floor(size / 1024.0 + 0.5)


def size_text(size: Column) -> Column:
    """Bytes, kb, mb or gb, rounded half up at each step; 0 shows as 1."""
    kb = _step(size)
    mb = _step(kb)
    gb = _step(mb)
    value = F.when(size < 1024, size.cast("bigint")).when(kb < 1024, kb).when(mb < 1024, mb).otherwise(gb)
    unit = F.when(size < 1024, "bytes").when(kb < 1024, "kb").when(mb < 1024, "mb").otherwise("gb")
    return F.concat_ws(" ", F.when(value == 0, F.lit(1)).otherwise(value).cast("bigint").cast("string"), unit)


def disk_size_markup(size: Column) -> Column:
    parts = F.split(size_text(size), " ")
    return F.concat(F.lit("<b>"), parts[0], F.lit("</b> "), parts[1])


def size_kb(size: Column) -> Column:
    return F.concat(F.greatest(F.lit(1).cast("bigint"), _step(size)).cast("string"), F.lit(" kb"))


def timestamp(days: Column, minutes: Column, ticks: Column) -> Column:
    """Days since 1978, minutes of the day and fiftieths of a second."""
    start = F.lit(EPOCH).cast("timestamp_ntz")
    return start + F.make_dt_interval(days.cast("int"), F.lit(0), minutes.cast("int"), (ticks / 50.0).cast("decimal(18,6)"))


def date_text(days: Column, minutes: Column, ticks: Column) -> Column:
    """day month year hour:minute, as ``1 jan 1978 00:00``."""
    at = timestamp(days, minutes, ticks)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(at))
    return F.concat_ws(" ", F.day(at).cast("string"), month, F.year(at).cast("string"), F.date_format(at, "HH:mm"))


def date_text_compat(days: Column, minutes: Column, ticks: Column) -> Column:
    """The text older viewers show (UTC): minutes count as hours and ticks as 50 seconds from an hour before 1978, and for hours
    under ten the padded hour takes the place of the minutes."""
    seconds = 252457200 + days * 86400 + minutes * 3600 + ticks * 50
    at = F.timestamp_seconds(seconds).cast("timestamp_ntz")
    hour, minute = F.hour(at), F.minute(at)
    shown = F.when(hour < 10, F.concat(F.lit("0"), hour.cast("string"))).otherwise(F.lpad(minute.cast("string"), 2, "0"))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(at))
    return F.concat_ws(" ", F.day(at).cast("string"), month, F.year(at).cast("string"), F.concat_ws(":", hour.cast("string"), shown))


def unix_date_text(seconds: Column) -> Column:
    """``D Mon YYYY H:M:S`` in UTC, nothing padded; years of five digits have no sign, which ``yyyy`` would give them."""
    rest = F.pmod(seconds, F.lit(86400))
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(((seconds - rest) / 86400).cast("int"), F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))
    return F.concat_ws(" ", F.date_format(at, "d MMM"), F.year(at).cast("string"), F.date_format(at, "H:m:s"))


def hex_byte(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2, "0")


def hex_lines(data: Column, width: int = 16) -> Column:
    """An array of lines of two-digit bytes."""
    parts = F.regexp_extract_all(F.hex(data), F.lit(f"(.{{1,{2 * width}}})"), F.lit(1))
    return F.transform(parts, lambda part: F.trim(F.regexp_replace(part, "(..)", "$1 ")))


def hex_dump(data: Column, width: int = 16) -> Column:
    return F.array_join(hex_lines(data, width), "\n")


def ascii_dump(data: Column, width: int = 16, spaced: bool = True) -> Column:
    """Latin-1 characters, spaced and in lines, or as they are."""
    text = F.decode(data, "ISO-8859-1")
    if not spaced:
        return text
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda part: F.regexp_replace(part, "(?s)(.)", "$1 ")), "\n")


def article(info: Column) -> Column:
    """``This is a`` or ``This is an``, by the first letter."""
    vowel = F.lower(F.substring(info, 1, 1)).isin("a", "e", "i", "o", "u")
    return F.concat(F.when(vowel, "This is an ").otherwise("This is a "), info)


def info_panel(name: Column, kind: Column, size: Column, comment: Column, days: Column, minutes: Column, ticks: Column) -> Column:
    """What a viewer lists about an entry; fields that are empty, and dates of the first 1000 days, are null."""
    shown = lambda c, when: F.when(when, c)
    return F.struct(name.alias("name"), kind.alias("type"), shown(size_text(size), size > 0).alias("size"), shown(comment, F.length(comment) > 0).alias("comment"), shown(date_text(days, minutes, ticks), days > 1000).alias("last_changed"))
