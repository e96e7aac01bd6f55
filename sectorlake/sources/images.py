"""Disk images as tables of sectors.

Images up to 2 GB are rows of Spark's ``binaryFile`` source: one row an image, read where Spark can read.  Larger ones
are read as fixed-length records, so that one image is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sectorlake.functions import binary as b
from sectorlake.functions.blocks import SECTOR

DD_SECTORS = 1760
TRACK, CYLINDER = 11, 22


def images(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(disk_id, path, length, content, sector_count, root_sector, md5, reject_reason) of every file under a path.

    A file that is no image keeps its row, with the reason; nothing fails the job.  Spark lists no empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return described(reader.load(path).select(F.col("path").alias("disk_id"), "path", "length", "content"))


def described(raw: DataFrame) -> DataFrame:
    """The same from rows (disk_id, content, ...) of any origin."""
    if "length" not in raw.columns:
        raw = raw.withColumn("length", F.octet_length("content").cast("bigint"))
    whole = F.col("length") % SECTOR == 0
    out = raw.withColumn("sector_count", F.expr(f"CAST(length DIV {SECTOR} AS INT)")).withColumn("root_sector", F.expr(f"CAST(length DIV {2 * SECTOR} AS INT)"))
    return out.withColumn("md5", F.md5("content")).withColumn("reject_reason", reject_reason(F.col("content"), F.col("sector_count"), F.col("root_sector"), whole))


def reject_reason(content: Column, count: Column, root: Column, whole: Column) -> Column:
    form = b.latin1(content, 0, 3)
    partitioned = b.latin1(content, 0, 4) == "RDSK"
    return (
        F.when(content.isNull() | (count == 0), "empty")
        .when(~whole, "size is not a whole number of sectors")
        .when(count % 2 != 0, "odd number of sectors")
        .when(partitioned, F.lit(None))
        .when(F.coalesce(b.u32(content, root * SECTOR), F.lit(-1)) != 2, "no root block")
        .when(form != "DOS", "not a DOS disk")
    )


def cut_sectors(content: Column, count: Column, size: int = SECTOR) -> Column:
    """The array of an image's sectors.  Exploding it keeps rows small: the image itself is not repeated beside each."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(content, k * size + 1, F.lit(size)))


def sectors(disks: DataFrame) -> DataFrame:
    """(disk_id, sector, data) of every whole sector; no shuffle."""
    some = disks.where(F.col("sector_count") > 0)
    return some.select("disk_id", F.posexplode(cut_sectors(F.col("content"), F.col("sector_count"))).alias("sector", "data"))


def large_sectors(spark: SparkSession, path: str) -> DataFrame:
    """The same of one image of any size, by fixed-length records; the file is split over tasks."""
    kind = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(path, kind, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{kind}.recordLength": str(SECTOR)})
    return spark.createDataFrame(records.map(lambda r: (path, int(r[0]), bytes(r[1]))), "disk_id string, sector bigint, data binary")


def read_range(disks: DataFrame, start: int, count: int = 1) -> DataFrame:
    """(disk_id, data): bytes of each image."""
    return disks.select("disk_id", F.substring("content", start + 1, count).alias("data"))


def read_sectors(disks: DataFrame, sector: int, count: int = 1) -> DataFrame:
    return read_range(disks, sector * SECTOR, count * SECTOR)


def track(disks: DataFrame, n: int = 0) -> DataFrame:
    return read_sectors(disks, n * TRACK, TRACK)


def cylinder(disks: DataFrame, n: int = 0) -> DataFrame:
    return read_sectors(disks, n * CYLINDER, CYLINDER)


def boot_block(disks: DataFrame) -> DataFrame:
    return read_sectors(disks, 0, 2)


def boot_track(disks: DataFrame) -> DataFrame:
    return read_sectors(disks, 2, 9)


def assemble(table: DataFrame) -> DataFrame:
    """(disk_id, content) from a table of sectors."""
    ordered = F.array_sort(F.collect_list(F.struct("sector", F.hex("data").alias("h"))))
    return table.groupBy("disk_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda r: r["h"]), "")).alias("content"))
