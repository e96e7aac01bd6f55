"""Watching a folder for new images (an extension: batch reads do the same work)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sectorlake.sources.images import described


def watched_images(spark: SparkSession, folder: str, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """A stream of the images that appear in a folder, described like ``images``; each file comes once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return described(stream.selectExpr("path AS disk_id", "path", "length", "content"))


def catalogue_stream(disks: DataFrame, known: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Look every new image up in the catalogue and append (disk_id, md5, name, outcome) as Parquet, exactly once."""
    from sectorlake.operators.catalogue import match

    first = match(disks.drop("content"), known).select("disk_id", "md5", "name", "outcome")
    writer = first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()
