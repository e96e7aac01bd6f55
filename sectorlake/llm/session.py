"""What the operators need of a session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_LOCAL = re.compile(r"local(\[[^\]]*\])?")
_swept: set[str] = set()


def root(spark: SparkSession) -> str:
    """This application's own folder inside the shared checkpoint folder; it goes when the application ends."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not _LOCAL.fullmatch(context.master):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sectorlake-"))
        found = context._jsc.sc().getCheckpointDir()
    if found.get() not in _swept:
        _swept.add(found.get())
        path = spark._jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there."""
    root(df.sparkSession)
    return df.checkpoint(eager=True)


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Stored:
    """A table written as Parquet to the shared checkpoint folder, until ``drop`` or the end of the application."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{root(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
