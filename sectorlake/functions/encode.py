"""Encoders of 512-byte sectors, as column expressions; the inverse of ``blocks``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sectorlake.functions import binary as b
from sectorlake.functions.blocks import FILE_TYPE, POINTERS, SECTOR


def _longs(values: Column, count: int) -> Column:
    """``count`` longs from an array; missing ones are zero."""
    text = F.array_join(F.transform(values, lambda x: F.lpad(F.hex(F.coalesce(x, F.lit(0)).cast("bigint")), 8, "0")), "")
    return F.unhex(F.rpad(F.substring(F.coalesce(text, F.lit("")), 1, 8 * count), 8 * count, "0"))


def _long(value) -> Column:
    return b.put(F.coalesce(b._col(value).cast("bigint"), F.lit(0).cast("bigint")), 4)


def _pascal(text: Column, size: int) -> Column:
    """A length byte and text in a field of ``size`` bytes."""
    raw = F.substring(b.put_latin1(F.coalesce(text, F.lit(""))), 1, size - 1)
    return F.rpad(F.concat(b.put(F.octet_length(raw), 1), raw), size, F.lit(b"\0"))


def sealed(data: Column, at: int = 20) -> Column:
    """With the checksum at its place."""
    return F.concat(F.substring(data, 1, at), b.put(b.checksum(data, ignore=at), 4), F.substring(data, at + 5, SECTOR - at - 4))


def header(h: Column, sector: Column) -> Column:
    """A root, directory or file header from a struct like ``blocks.header`` gives."""
    root = h["type_string"] == "ROOT"
    kind = F.when(root, 1).when(h["type_string"] == "FILE", FILE_TYPE).otherwise(2).cast("bigint")
    stamp = [_long(h[f"change_{x}"]) for x in ("days", "minutes", "ticks")]
    start = F.concat(_long(2), F.when(root, _long(0)).otherwise(_long(sector)), _long(h["data_block_count"]), _long(h["data_size"]), _long(h["first_data_block"]), _long(0), _longs(h["pointers"], POINTERS))
    as_root = F.concat(_long(h["bm_flag"]), _longs(h["bitmap_blocks"], 25), _long(h["bitmap_ext"]), *stamp, _pascal(h["name"], 40), *(_long(h[f"disk_change_{x}"]) for x in ("days", "minutes", "ticks")), b.filled(24), _long(kind))
    as_entry = F.concat(b.filled(12), _long(h["size"]), _pascal(h["comment"], 92), *stamp, _pascal(h["name"], 64), _long(h["linked_sector"]), _long(h["parent"]), _long(h["data_block_extension"]), _long(kind))
    return sealed(F.concat(start, F.when(root, as_root).otherwise(as_entry)))


def extension(pointers: Column, sector: Column, parent: Column, following: Column) -> Column:
    count = F.size(F.filter(pointers, lambda p: p != 0))
    start = F.concat(_long(16), _long(sector), _long(count), b.filled(12), _longs(pointers, POINTERS))
    return sealed(F.concat(start, b.filled(SECTOR - 312 - 12), _long(parent), _long(following), _long(FILE_TYPE)))


def ofs_data(payload: Column, header_sector: Column, number: Column, following: Column) -> Column:
    part = F.substring(payload, 1, SECTOR - 24)
    return sealed(F.concat(_long(8), _long(header_sector), _long(number), _long(F.octet_length(part)), _long(following), _long(0), F.rpad(part, SECTOR - 24, F.lit(b"\0"))))


def ffs_data(payload: Column) -> Column:
    return F.rpad(F.substring(payload, 1, SECTOR), SECTOR, F.lit(b"\0"))


def bitmap(longs: Column) -> Column:
    return sealed(F.concat(_long(0), _longs(longs, 127)), at=0)


def packed_longs(bits, by: list[str], bit: str = "bit_idx", free: str = "free"):
    """(by..., word, value) from a table of single bits: each 32 of them are one long, lowest bit first."""
    marked = bits.withColumn("word", F.expr(f"CAST({bit} DIV 32 AS INT)"))
    value = F.sum(F.expr(f"CASE WHEN {free} = 1 THEN shiftleft(1L, CAST({bit} % 32 AS INT)) ELSE 0L END"))
    return marked.groupBy(*by, "word").agg(value.alias("value"))
