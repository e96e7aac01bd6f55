"""Writes as overlays: rows of a patch take the place of the base rows with their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def overlay(base: DataFrame, patch: DataFrame, key: list[str]) -> DataFrame:
    return base.join(patch.select(*key).distinct(), key, "left_anti").unionByName(patch)


def write_sectors(sectors: DataFrame, patch: DataFrame, size: int = 512) -> DataFrame:
    """Overwrite whole sectors; missing bytes are zero."""
    padded = patch.withColumn("data", F.rpad(F.substring("data", 1, size), size, F.lit(b"\0")))
    return overlay(sectors, padded.select(*sectors.columns), ["disk_id", "sector"])


def clear_sectors(sectors: DataFrame, which: DataFrame, size: int = 512) -> DataFrame:
    """Zero the sectors that ``which`` (disk_id, sector) names."""
    return write_sectors(sectors, which.select("disk_id", "sector", F.lit(b"").alias("data")), size)
