"""Changes to volumes: files and folders written, renamed and deleted.

Requests of one image are applied in their order (``seq``) to a copy of it, inside the image's own row: allocation is
first-fit and depends on what was written before, while images do not depend on each other.  A request that cannot be
carried out leaves the image as it was and says why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sectorlake import small_batches
from sectorlake.functions.blocks import FFS_PAYLOAD, OFS_PAYLOAD, POINTERS
from sectorlake.functions.image import Image, ImageError, blank

_REQUEST = ["seq", "op", "path", "name", "content"]


def write_file(image: Image, path: str, name: str, content: bytes | None, duplicates: bool, stamp: tuple[int, int, int]) -> int:
    return image.write_file(name, content or b"", image.resolve(path or ""), duplicates, stamp)


def create_folder(image: Image, path: str, name: str, content, duplicates: bool, stamp: tuple[int, int, int]) -> int:
    return image.create_folder(name, image.resolve(path or ""), duplicates, stamp)


def delete(image: Image, path: str, name, content, duplicates, stamp) -> int:
    image.delete(sector := image.resolve(path or ""))
    return sector


def rename(image: Image, path: str, name: str, content, duplicates: bool, stamp) -> int:
    image.rename(sector := image.resolve(path or ""), name, duplicates)
    return sector


OPERATIONS = {"write": write_file, "mkdir": create_folder, "delete": delete, "rename": rename}


def apply(disks: DataFrame, requests: DataFrame, on_duplicate: str = "reject", as_of: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """requests: (disk_id, seq, op, path, name, content).  op: write or mkdir (path: the folder, name), delete (path), rename
    (path, name: the new one).

    Returns (disk_id, content, results array<struct<seq, sector, error>>) of every image that has requests; an image's requests
    must fit in memory with it.  as_of: the date stamp of what is written.
    """
    return _changed(disks.select("disk_id", "content"), lambda content: bytearray(content or b""), requests, on_duplicate, as_of)


def create(spec: DataFrame, requests: DataFrame, on_duplicate: str = "reject", as_of: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """``apply`` to images that are formatted for it (spec: as of ``format_images``), in one step: no empty image is moved."""
    return _changed(spec.select("disk_id", "sectors", "label", "ffs"), lambda sectors, label, ffs: blank(sectors, label or "", bool(ffs)), requests, on_duplicate, as_of)


def _changed(disks: DataFrame, start: Callable[..., bytearray], requests: DataFrame, on_duplicate: str, as_of: tuple[int, int, int]) -> DataFrame:
    """start: the image's bytes from the columns behind disk_id."""
    if on_duplicate not in ("reject", "allow"):
        raise ValueError("on_duplicate: reject or allow")
    asked = requests.groupBy("disk_id").agg(F.array_sort(F.collect_list(F.struct(*_REQUEST))).alias("asked"))
    schema = "disk_id string, content binary, results array<struct<seq: bigint, sector: int, error: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("seq", pa.int64()), ("sector", pa.int32()), ("error", pa.string())]))
        for batch in batches:
            for k in range(batch.num_rows):
                _, *own, asked_ = (c[k].as_py() for c in batch.columns)
                content, results = start(*own), []
                try:
                    image = Image(content)
                except ImageError as e:
                    image, problem = None, str(e)
                for r in asked_:
                    try:
                        if image is None:
                            raise ImageError(problem)
                        if r["op"] not in OPERATIONS:
                            raise ImageError(f"no operation {r['op']}")
                        sector = OPERATIONS[r["op"]](image, r["path"], r["name"], r["content"], on_duplicate == "allow", as_of)
                        results.append({"seq": r["seq"], "sector": sector, "error": None})
                    except (ImageError, AttributeError, TypeError) as e:
                        results.append({"seq": r["seq"], "sector": None, "error": str(e)})
                changed = bytes(content) if image or batch.column(1)[k].is_valid else None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([changed], pa.binary()), pa.array([results], kind)], names=["disk_id", "content", "results"])

    small_batches(disks.sparkSession)
    return disks.join(asked, "disk_id").mapInArrow(run, schema)


def upload(disks: DataFrame, host_files: DataFrame, disk_id: str, folder: str = "") -> DataFrame:
    """Write files of the ``binaryFile`` source into a folder of one image, in the order of their paths."""
    order = host_files.select("path", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")).cast("bigint").alias("seq"))  # paths alone: one image's
    named = host_files.join(order, "path").select(F.lit(disk_id).alias("disk_id"), "seq", F.lit("write").alias("op"), F.lit(folder).alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return apply(disks.where(F.col("disk_id") == disk_id), named)


def block_need(size: Column, ffs: Column) -> Column:
    """struct(data_blocks, header_blocks, total): an empty file still has its header."""
    data = F.ceil(size / F.when(ffs, FFS_PAYLOAD).otherwise(OFS_PAYLOAD))
    heads = F.greatest(F.lit(1), F.ceil(data / POINTERS))
    return F.struct(data.alias("data_blocks"), heads.alias("header_blocks"), (data + heads).alias("total"))


def block_need_compat(size: Column, ffs: Column) -> Column:
    """The same by the formula that counts nothing for an empty file."""
    data = F.ceil(size / F.when(ffs, FFS_PAYLOAD).otherwise(OFS_PAYLOAD))
    heads = F.ceil(data / POINTERS)
    return F.struct(data.alias("data_blocks"), heads.alias("header_blocks"), (data + heads).alias("total"))


def format_images(spec: DataFrame) -> DataFrame:
    """spec: (disk_id, sectors int, label string, ffs boolean).  (disk_id, content) of formatted, empty images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                disk, sectors, label, ffs = (c[k].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([disk]), pa.array([bytes(blank(sectors, label or "", bool(ffs)))], pa.binary())], names=["disk_id", "content"])

    return spec.select("disk_id", "sectors", "label", "ffs").mapInArrow(run, "disk_id string, content binary")
