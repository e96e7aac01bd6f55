"""Images and files written out through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sectorlake.sources.images import DD_SECTORS


def image_name(label: Column, sector_count: Column) -> Column:
    """The file name of a whole image: its label with the suffix of floppies or hard disks."""
    return F.concat(label, F.when(sector_count == DD_SECTORS, ".adf").otherwise(".hdf"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[/\\:\x00-\x1f]", "_")


def export(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write each row's content as a file of its name in a folder of any file system Spark can write; the number written.

    Rows that share a name overwrite each other; make names unique first.  Each row is one write of its whole content, so
    a task that is repeated gives the same files.
    """
    spark = rows.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    local = folder.removeprefix("file://")
    if "://" in local:
        import pyarrow.fs as pafs

        def put(path: str, data: bytes) -> None:
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_output_stream(at) as out:
                out.write(data)
    else:

        def put(path: str, data: bytes) -> None:
            with open(path, "wb") as out:
                out.write(data)

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                put(f"{local}/{n}", c or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = rows.select(safe_name(F.col(name)).alias("name"), F.col(content).alias("content")).mapInArrow(write, "n bigint")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
