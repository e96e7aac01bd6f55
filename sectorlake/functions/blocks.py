"""Decoders of 512-byte sectors, as struct-valued column expressions.

Layout offsets are fixed by the file-system format.  Checksums are shown (``checksum_ok``) and never filter rows, so that
damaged images can still be read.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sectorlake.functions import binary as b
from sectorlake.functions.formats import timestamp

SECTOR = 512
POINTERS = 72
BITMAP_BITS = 127 * 32
OFS_PAYLOAD, FFS_PAYLOAD = 488, 512
FILE_TYPE = 4294967293  # -3 as an unsigned long
ROOT_TYPE = 1


def sector_type(sector: Column, root: Column, code: Column, is_bitmap: Column) -> Column:
    """The kind of a sector; ``code``: its first long."""
    return (
        F.when(sector == 0, "BOOTBLOCK")
        .when(sector == root, "ROOTBLOCK")
        .when(is_bitmap, "BITMAP BLOCK")
        .when(code == 2, "HEADER")
        .when(code == 8, "DATA BLOCK")
        .when(code == 16, "LIST")
        .when(code == 33, "DIRCACHE")
        .otherwise("EMPTY")
    )


def entry_type(data: Column, in_range: Column) -> Column:
    """FILE, DIR (whatever is no file) or INVALID."""
    return F.when(~in_range, "INVALID").when(b.u32(data, SECTOR - 4) == FILE_TYPE, "FILE").otherwise("DIR")


def entry_name(data: Column) -> Column:
    return b.pascal(data, SECTOR - 80)


def header(data: Column) -> Column:
    """A root, directory or file header."""
    kind = b.u32(data, SECTOR - 4)
    root = kind == ROOT_TYPE
    unless_root = lambda c: F.when(~root, c)
    stamp = lambda at: [b.u32(data, at + 4 * k) for k in range(3)]
    changed = stamp(SECTOR - 92)
    disk = stamp(SECTOR - 40)
    stored = b.u32(data, 20)
    safe = (changed[0] < 100_000) & (changed[1] < 1440) & (changed[2] < 3000)
    return F.struct(
        b.u32(data, 0).alias("type"),
        b.u32(data, 4).alias("header_sector"),
        b.u32(data, 8).alias("data_block_count"),
        b.u32(data, 12).alias("data_size"),
        b.u32(data, 16).alias("first_data_block"),
        stored.alias("checksum"),
        (stored == b.checksum(data)).alias("checksum_ok"),
        b.u32_array(data, 24, POINTERS).alias("pointers"),
        unless_root(b.u32(data, SECTOR - 188)).alias("size"),
        unless_root(b.pascal(data, SECTOR - 184)).alias("comment"),
        unless_root(b.u32(data, SECTOR - 16)).alias("linked_sector"),
        unless_root(b.u32(data, SECTOR - 12)).alias("parent"),
        unless_root(b.u32(data, SECTOR - 8)).alias("data_block_extension"),
        F.when(root, "ROOT").when(kind == FILE_TYPE, "FILE").otherwise("DIR").alias("type_string"),
        changed[0].alias("change_days"),
        changed[1].alias("change_minutes"),
        changed[2].alias("change_ticks"),
        F.when(safe, timestamp(*changed)).alias("changed_at"),
        entry_name(data).alias("name"),
        F.when(root, b.u32(data, SECTOR - 200)).alias("bm_flag"),
        F.when(root, b.u32_array(data, SECTOR - 196, 25)).alias("bitmap_blocks"),
        F.when(root, b.u32(data, SECTOR - 96)).alias("bitmap_ext"),
        F.when(root, disk[0]).alias("disk_change_days"),
        F.when(root, disk[1]).alias("disk_change_minutes"),
        F.when(root, disk[2]).alias("disk_change_ticks"),
    )


def ofs_data(data: Column) -> Column:
    """A data block with a header; one of another type has no payload and no successor."""
    good = b.u32(data, 0) == 8
    size = F.least(b.u32(data, 12), F.lit(OFS_PAYLOAD)).cast("int")
    return F.struct(
        b.u32(data, 0).alias("type"),
        b.u32(data, 4).alias("header_sector"),
        b.u32(data, 8).alias("number"),
        F.when(good, b.u32(data, 12)).otherwise(0).cast("bigint").alias("data_size"),
        F.when(good, b.u32(data, 16)).otherwise(0).cast("bigint").alias("next_data_block"),
        b.u32(data, 20).alias("checksum"),
        F.when(good, b.read_bytes(data, 24, size)).otherwise(F.lit(b"")).alias("content"),
    )


def ffs_data(data: Column, remaining) -> Column:
    """A raw data block: what the file still needs of it."""
    size = F.least(b._col(remaining), F.lit(FFS_PAYLOAD)).cast("int")
    return F.struct(size.cast("bigint").alias("data_size"), b.read_bytes(data, 0, size).alias("content"))


def extension(data: Column) -> Column:
    return F.struct(
        b.u32(data, 0).alias("type"),
        b.u32(data, 4).alias("header_sector"),
        b.u32(data, 8).alias("data_block_count"),
        b.u32(data, 20).alias("checksum"),
        (b.u32(data, 20) == b.checksum(data)).alias("checksum_ok"),
        b.u32_array(data, 24, POINTERS).alias("pointers"),
        b.u32(data, SECTOR - 12).alias("parent"),
        b.u32(data, SECTOR - 8).alias("data_block_extension"),
    )


def bitmap(data: Column) -> Column:
    """(checksum, checksum_ok, longs): the 127 longs; a set bit is a free sector, lowest bit first."""
    return F.struct(b.u32(data, 0).alias("checksum"), (b.u32(data, 0) == b.checksum(data, ignore=0)).alias("checksum_ok"), b.u32_array(data, 4, 127).alias("longs"))


def bitmap_extension(data: Column) -> Column:
    return F.struct(b.u32_array(data, 0, 127).alias("pointers"), b.u32(data, SECTOR - 4).alias("next"))


def free_bits(longs: Column) -> Column:
    """The number of free sectors that a bitmap block's longs mark."""
    return F.aggregate(F.transform(longs, F.bit_count), F.lit(0).cast("bigint"), lambda a, x: a + x)
