"""What is on a volume: information, free space, headers, bitmaps, directories, files and paths.

Tables keyed by disk_id.  Decoders that need one sector at a time are column expressions over ``sectors``; walks along
pointers run inside the image's own row (``mapInArrow``), so an image's links cost no shuffle and a damaged image
cannot hold up others: walks stop at sectors already seen and at pointers outside the image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sectorlake import small_batches
from sectorlake.functions import binary as b, blocks
from sectorlake.functions.blocks import SECTOR
from sectorlake.functions.image import Image, ImageError


def per_image(disks: DataFrame, rows: Callable[[Image], list[tuple]], schema: str) -> DataFrame:
    """Rows that a function makes of each readable image, after its disk_id."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(f"disk_id string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            for k in range(batch.num_rows):
                disk = batch.column(0)[k].as_py()
                try:
                    found = rows(Image(batch.column(1)[k].as_py()))
                except ImageError:
                    continue
                if found:
                    columns = list(zip(*((disk, *r) for r in found), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    small_batches(disks.sparkSession)
    return disks.where("reject_reason IS NULL").select("disk_id", "content").mapInArrow(run, kind)


def disk_info(disks: DataFrame) -> DataFrame:
    """(disk_id, disk_format, disk_type, root_type, label, total_size, free, used); a partitioned disk has no label or sizes."""
    content, root = F.col("content"), F.col("root_sector") * SECTOR
    partitioned = b.latin1(content, 0, 4) == "RDSK"
    known = b.u32(content, root) == 2
    flag = F.when(b.u8(content, 3) % 2 == 0, "OFS").otherwise("FFS")
    space = F.when(F.col("reject_reason").isNull(), _space_udf(content))
    return disks.select(
        "disk_id",
        F.when(partitioned, "RDSK").when(known, b.latin1(content, 0, 3)).otherwise("UNKNOWN").alias("disk_format"),
        F.when(partitioned, "Partitioned").when(known, flag).otherwise("UNKNOWN").alias("disk_type"),
        F.when(~partitioned, b.u32(content, root)).alias("root_type"),
        F.when(~partitioned, b.pascal(content, root + SECTOR - 80)).alias("label"),
        space.alias("space"),
    ).select("*", "space.*").drop("space")


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("total_size", "free", "used")]))
def _space_udf(contents: pa.Array) -> pa.Array:
    out = []
    for c in contents:
        try:
            out.append(dict(zip(("total_size", "free", "used"), Image(c.as_py()).free_size()[1:], strict=True)))
        except (ImageError, TypeError):
            out.append(None)
    return pa.array(out, pa.struct([(n, pa.int64()) for n in ("total_size", "free", "used")]))


def _bitmap_pointers(disks: DataFrame) -> DataFrame:
    """(disk_id, blk_idx, block) of each bitmap block, those of the extension chain after the root's 25."""
    return per_image(disks, lambda im: list(enumerate(im.bitmap_blocks)), "blk_idx int, block int")


def bitmap(disks: DataFrame) -> DataFrame:
    """(disk_id, blk_idx, bit_idx, sector, free): one row for each bit of each bitmap block."""
    found = disks.where("reject_reason IS NULL").select("disk_id", "content", _pointers_udf(F.col("content")).alias("at"))
    maps = F.transform("at", lambda p: F.when(p > 0, F.substring("content", p * SECTOR + 1, F.lit(SECTOR))))
    one = found.select("disk_id", F.posexplode(maps).alias("blk_idx", "data")).where("data IS NOT NULL")
    longs = one.select("disk_id", "blk_idx", b.u32_array(F.col("data"), 4, 127).alias("longs"))
    words = longs.select("disk_id", "blk_idx", F.posexplode("longs").alias("word", "value"))
    bits = words.select("disk_id", "blk_idx", "word", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    at = (F.col("word") * 32 + F.col("bit")).cast("int")
    return bits.select("disk_id", "blk_idx", at.alias("bit_idx"), (2 + F.col("blk_idx") * blocks.BITMAP_BITS + at).cast("int").alias("sector"), F.expr("CAST(bit_get(value, bit) AS INT)").alias("free"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _pointers_udf(contents: pa.Array) -> pa.Array:
    out = []
    for c in contents:
        try:
            out.append(Image(c.as_py()).bitmap_blocks)
        except (ImageError, TypeError):
            out.append([])
    return pa.array(out, pa.list_(pa.int32()))


def free_size(disks: DataFrame, strict: bool = False) -> DataFrame:
    """(disk_id, free_blocks, total_size, free, used).

    As viewers count: the set bits among the first sector_count bits of the bitmaps; ``strict`` leaves out the last two, which
    stand for no sector, since the first bit is sector 2."""
    return per_image(disks, lambda im: [im.free_size(strict)], "free_blocks bigint, total_size bigint, free bigint, used bigint")


def headers(sectors: DataFrame) -> DataFrame:
    """Every root, directory and file header, decoded; a narrow table."""
    found = sectors.where(b.u32(F.col("data"), 0) == 2)
    return found.select("disk_id", "sector", blocks.header(F.col("data")).alias("h")).select("disk_id", "sector", "h.*")


def extension_blocks(sectors: DataFrame) -> DataFrame:
    found = sectors.where(b.u32(F.col("data"), 0) == 16)
    return found.select("disk_id", "sector", blocks.extension(F.col("data")).alias("x")).select("disk_id", "sector", "x.*")


def data_blocks(sectors: DataFrame) -> DataFrame:
    found = sectors.where(b.u32(F.col("data"), 0) == 8)
    return found.select("disk_id", "sector", blocks.ofs_data(F.col("data")).alias("x")).select("disk_id", "sector", "x.*")


def bitmap_blocks(disks: DataFrame) -> DataFrame:
    """(disk_id, blk_idx, block)."""
    return _bitmap_pointers(disks)


def sector_types(disks: DataFrame, sectors: DataFrame) -> DataFrame:
    """(disk_id, sector, sector_type)."""
    marks = bitmap_blocks(disks).where("block > 0").select("disk_id", F.col("block").alias("sector"), F.lit(True).alias("mark")).distinct()
    coded = sectors.select("disk_id", "sector", b.u32(F.col("data"), 0).alias("code")).join(disks.select("disk_id", "root_sector"), "disk_id")
    typed = blocks.sector_type(F.col("sector"), F.col("root_sector"), F.col("code"), F.coalesce("mark", F.lit(False)))
    return coded.join(marks, ["disk_id", "sector"], "left").select("disk_id", "sector", typed.alias("sector_type"))


def is_empty(disks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (disk_id, sector).  Adds ``empty``: its bitmap bit is set; false outside the image."""
    found = disks.where("reject_reason IS NULL").select("disk_id", "content", "sector_count", _pointers_udf(F.col("content")).alias("at"))
    maps = F.transform("at", lambda p: F.when(p > 0, F.substring("content", p * SECTOR + 1, F.lit(SECTOR))))
    blocks_ = found.select("disk_id", "sector_count", F.posexplode(maps).alias("_block", "data")).where("data IS NOT NULL")
    longs = blocks_.select("disk_id", "sector_count", "_block", b.u32_array(F.col("data"), 4, 127).alias("_longs"))
    asked = wanted.withColumn("_block", F.expr(f"CAST((sector - 2) DIV {blocks.BITMAP_BITS} AS INT)"))
    bit = f"(sector - 2) % {blocks.BITMAP_BITS}"  # 32 to a long, lowest first
    known = F.col("sector").between(2, F.col("sector_count") - 1)
    empty = F.when(known, F.expr(f"bit_get(_longs[CAST({bit} DIV 32 AS INT)], CAST({bit} % 32 AS INT)) = 1"))
    return asked.join(longs, ["disk_id", "_block"], "left").withColumn("empty", F.coalesce(empty, F.lit(False))).drop("_block", "_longs", "sector_count")


_ENTRY = "dir_sector int, bucket int, depth int, sector int, name string, type_string string, size bigint, comment string, parent int, linked_sector int, change_days bigint, change_minutes bigint, change_ticks bigint, dir_name string"


def dir_entries(disks: DataFrame, folder: int | None = None) -> DataFrame:
    """The entries of every folder, of one folder's sector, or with ``folder=0`` of the root.  depth: place in the hash chain;
    dir_name: the folder's name, empty for the root."""

    def rows(im: Image) -> list[tuple]:
        wanted = im.folders() if folder is None else [folder or im.root]
        named = [(d, "" if d == im.root or not im.valid(d) else im.text(d, SECTOR - 80)) for d in wanted]
        return [(d, e.bucket, e.depth, e.sector, e.name, e.kind, e.size, e.comment, e.parent, e.linked, *e.changed, name) for d, name in named for e in im.entries(d)]

    return per_image(disks, rows, _ENTRY)


def listing(entries: DataFrame) -> DataFrame:
    """Entries as a viewer shows them: ``position`` within a folder, folders first, then by name."""
    from pyspark.sql import Window

    kind = F.when(F.col("type_string") == "DIR", 0).otherwise(1)
    return entries.withColumn("position", F.row_number().over(Window.partitionBy("disk_id", "dir_sector").orderBy(kind, "name", "sector")))


def parent_entry(entries: DataFrame) -> DataFrame:
    """(disk_id, dir_sector, folder, parent_sector) of each folder that has one."""
    return entries.where("type_string = 'DIR'").select("disk_id", F.col("sector").alias("dir_sector"), F.col("name").alias("folder"), F.col("parent").alias("parent_sector")).where("parent_sector > 0").distinct()


def files(disks: DataFrame, include_content: bool = True, pointers: bool = True) -> DataFrame:
    """(disk_id, sector, path, name, size, content) of every file that a folder reaches.

    Content comes from the header's and extensions' pointers, or (``pointers=False``, OFS) from the chain of data blocks; what a
    damaged file lacks is zero."""

    def rows(im: Image) -> list[tuple]:
        return [(e.sector, path, e.name, e.size, im.content(e.sector, pointers) if include_content else None) for path, e in im.walk() if e.kind == "FILE"]

    return per_image(disks, rows, "sector int, path string, name string, size bigint, content binary")


def file_blocks(disks: DataFrame) -> DataFrame:
    """(disk_id, file_sector, seq, data_sector, n_bytes)."""

    def rows(im: Image) -> list[tuple]:
        return [(e.sector, k, s, n) for _, e in im.walk() if e.kind == "FILE" for k, (s, n) in enumerate(im.data_sectors(e.sector))]

    return per_image(disks, rows, "file_sector int, seq int, data_sector int, n_bytes int")


def tree(disks: DataFrame) -> DataFrame:
    """(disk_id, path, sector, type_string, size) of everything below the root."""
    return per_image(disks, lambda im: [(p, e.sector, e.kind, e.size) for p, e in im.walk()], "path string, sector int, type_string string, size bigint")


def chain_predecessor(disks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (disk_id, sector).  Adds ``predecessor``: the entry whose hash chain link leads there (null: the chain's head)."""
    links = dir_entries(disks).where("linked_sector > 0").select("disk_id", F.col("linked_sector").alias("sector"), F.col("sector").alias("predecessor"))
    return wanted.join(links, ["disk_id", "sector"], "left")


def chains(disks: DataFrame) -> DataFrame:
    """(disk_id, sector, name, type_string, predecessor, predecessor_name) of every entry, as of ``chain_predecessor``, in one pass
    over each image."""

    def rows(im: Image) -> list[tuple]:
        found, links = [e for d in im.folders() for e in im.entries(d)], {}
        for e in found:
            if e.linked > 0:
                links.setdefault(e.linked, []).append((e.sector, e.name))
        return [(e.sector, e.name, e.kind, *p) for e in found for p in links.get(e.sector, [(None, None)])]

    return per_image(disks, rows, "sector int, name string, type_string string, predecessor int, predecessor_name string")


def empty_folders(disks: DataFrame) -> DataFrame:
    """(disk_id, sector, name) of folders without any pointer."""
    return per_image(disks, lambda im: [(s, im.text(s, SECTOR - 80)) for s in im.folders() if s != im.root and not any(im.pointers(s))], "sector int, name string")


def first_free(disks: DataFrame) -> DataFrame:
    """(disk_id, sector): the lowest free sector; a full disk has no row."""
    return per_image(disks, lambda im: [(s,) for s in [im.first_free()] if s is not None], "sector int")


def rewrite_blocks(sectors: DataFrame) -> DataFrame:
    """Headers decoded and encoded again, (disk_id, sector, data, read): equal to what was ``read``, but for unused bytes."""
    from sectorlake.functions.encode import header as encode_header

    found = sectors.where(b.u32(F.col("data"), 0) == 2).select("disk_id", "sector", blocks.header(F.col("data")).alias("h"), F.col("data").alias("read"))
    return found.select("disk_id", "sector", encode_header(F.col("h"), F.col("sector")).alias("data"), "read")


def paths(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes: (id, parent, name).  (id, path, depth), from the roots down to a known number of levels, by equi-joins."""
    level = nodes.where("parent IS NULL").select("id", F.col("name").alias("path"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, levels):
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        level = nodes.join(above, "parent").select("id", F.concat_ws("/", "above", "name").alias("path"), F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out


def sector_dump(disks: DataFrame, sector: int) -> DataFrame:
    """(disk_id, sector, hex, ascii) of one sector of each image; a number outside the image is held inside it."""
    from sectorlake.functions.formats import ascii_dump, hex_dump

    some = disks.where("sector_count > 0").withColumn("sector", b.clamp(sector, F.col("sector_count")).cast("int"))
    data = F.substring("content", F.col("sector") * SECTOR + 1, F.lit(SECTOR))
    return some.select("disk_id", "sector", data.alias("data")).select("disk_id", "sector", hex_dump(F.col("data")).alias("hex"), ascii_dump(F.col("data")).alias("ascii"))


def display_path(info: DataFrame, entries: DataFrame, compat: bool = False) -> DataFrame:
    """entries: (disk_id, path, ...) as of ``tree``.  Adds ``shown``: the label and the path, or (compat) only its last name."""
    name = F.element_at(F.split("path", "/"), -1) if compat else F.col("path")
    return entries.join(info.select("disk_id", "label"), "disk_id").withColumn("shown", F.concat_ws("/", "label", name)).drop("label")
