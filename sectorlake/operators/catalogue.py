"""Lookup of images in a catalogue of known disks, by MD5."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def match(images: DataFrame, known: DataFrame, position: str | None = None) -> DataFrame:
    """images: (md5, reject_reason, ...); known: (md5, name [, position]).  Adds ``name`` and ``outcome``.

    Of several entries with one MD5 the first by position (else by name) counts.  The catalogue is aggregated before the
    join; Spark broadcasts it while it is under its size threshold.  A null MD5 is a lookup that failed.
    """
    first = known.groupBy("md5").agg(F.min_by("name", F.col(position or "name")).alias("name"))
    outcome = (
        F.when(F.col("reject_reason").isNotNull(), "This is not a standard disk image")
        .when(F.col("md5").isNull(), "Sorry, something went wrong ...")
        .when(F.col("name").isNotNull(), F.concat(F.lit("Yes: "), F.col("name")))
        .otherwise("Nope! This disk is not in the catalogue!")
    )
    return images.join(first, "md5", "left").withColumn("outcome", outcome)
