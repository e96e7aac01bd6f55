"""Queries over images, raw sectors, archives and pictures that are made of the driver's tables, with the same in DuckDB SQL.

Images: every 64 doc_ids of a language are a volume with a folder for each source and a file for each document (``contract``).
Raw disks: the bytes of ``pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sectorlake import small_batches
from sectorlake.functions import binary as b, encode
from sectorlake.operators import archive, detect, iff, overlay, volume, write
from sectorlake.plans.contract import _IMAGE_SQL, _NEED, HASH_SQL, _blocks_sql, _image_files, _written_images, content, query, table
from sectorlake.sources import images

_FILES = f"files AS (SELECT *, greatest(1, CAST(ceil(data / 72.0) AS BIGINT)) AS heads FROM (SELECT *, {_NEED} AS data FROM ({_IMAGE_SQL})))"
_MADE = f"""{_FILES}, used AS (SELECT disk_id, ffs, CAST(sum(data + heads) + count(DISTINCT source) AS BIGINT) AS blocks, count(DISTINCT source) AS folders FROM files GROUP BY ALL),
    made AS (SELECT *, CAST(ceil((sectors - 2) / 4064.0) AS BIGINT) AS maps FROM (SELECT *, (blocks + blocks // 2000 * 2 + 16 + 1) // 2 * 2 AS sectors FROM used))"""
_FREE = "sectors - 3 - maps - blocks"


def _bucket_sql(name: str) -> str:
    return HASH_SQL.replace("p_name", f"({name})")


def _named(df: DataFrame, heads: DataFrame, at: str) -> DataFrame:
    """With the name of the header that a column points to."""
    return df.join(heads.select("disk_id", F.col("sector").alias(at), F.col("name").alias(f"{at}_name")), ["disk_id", at])


@query(f"WITH {_MADE} SELECT disk_id, 'DOS' AS disk_format, CASE WHEN ffs THEN 'FFS' ELSE 'OFS' END AS disk_type, CAST(2 AS BIGINT) AS root_type, disk_id AS label, sectors * 512 AS total_size, ({_FREE}) * 512 AS free, (sectors - ({_FREE})) * 512 AS used FROM made")
def image_info(spark, sf_dir):
    return volume.disk_info(_written_images(spark, sf_dir))


@query(f"""
    WITH {_MADE}, heads AS (
        SELECT disk_id, 'FILE' AS type_string, 'doc' || doc_id AS name, CAST(size AS BIGINT) AS size, data AS data_block_count, least(72, data) AS pointers FROM files
        UNION ALL SELECT disk_id, 'DIR', source, 0, 0, count(DISTINCT {_bucket_sql("'doc' || doc_id")}) FROM files GROUP BY disk_id, source
        UNION ALL SELECT disk_id, 'ROOT', disk_id, NULL, 0, count(DISTINCT {_bucket_sql("source")}) FROM files GROUP BY disk_id)
    SELECT *, true AS checksum_ok FROM heads""")
def image_headers(spark, sf_dir):
    """Every header of the images, decoded from its sector."""
    heads = volume.headers(images.sectors(_written_images(spark, sf_dir)))
    used = F.size(F.filter("pointers", lambda p: p != 0)).cast("bigint")
    return heads.select("disk_id", "type_string", "name", "size", "data_block_count", used.alias("pointers"), "checksum_ok")


@query(f"WITH {_FILES} SELECT disk_id, 'doc' || doc_id AS name, least(72, data - 72 * k) AS data_block_count, true AS checksum_ok FROM (SELECT *, unnest(range(1, heads)) AS k FROM files)")
def image_extensions(spark, sf_dir):
    sectors = images.sectors(_written_images(spark, sf_dir))
    return _named(volume.extension_blocks(sectors), volume.headers(sectors), "parent").select("disk_id", F.col("parent_name").alias("name"), "data_block_count", "checksum_ok")


@query(f"SELECT disk_id, 'doc' || b.doc_id AS name, b.seq + 1 AS number, length(b.data) // 2 AS data_size, md5(b.data) AS md5 FROM {_blocks_sql(488)} AS b JOIN ({_IMAGE_SQL}) AS f ON b.doc_id = f.doc_id WHERE NOT ffs")
def image_data_blocks(spark, sf_dir):
    """Data blocks with headers, of the images that have them."""
    sectors = images.sectors(_written_images(spark, sf_dir))
    found = _named(volume.data_blocks(sectors), volume.headers(sectors), "header_sector")
    return found.select("disk_id", F.col("header_sector_name").alias("name"), F.col("number").cast("bigint").alias("number"), "data_size", F.md5(F.hex("content")).alias("md5"))


@query(f"WITH {_FILES} SELECT disk_id, source || '/doc' || doc_id AS path, CAST(seq AS INTEGER) AS seq, CAST(least(p, size - seq * p) AS INTEGER) AS n_bytes FROM (SELECT *, CASE WHEN ffs THEN 512 ELSE 488 END AS p, unnest(range(data)) AS seq FROM files)")
def image_blocks(spark, sf_dir):
    """The data blocks of every file in order."""
    disks = _written_images(spark, sf_dir)
    paths = volume.files(disks, include_content=False).select("disk_id", F.col("sector").alias("file_sector"), "path")
    return volume.file_blocks(disks).join(paths, ["disk_id", "file_sector"]).select("disk_id", "path", "seq", "n_bytes")


@query(f"SELECT disk_id, source || '/doc' || doc_id AS path, md5(text) AS md5 FROM ({_IMAGE_SQL}) WHERE NOT ffs")
def image_chain_files(spark, sf_dir):
    """Files read along the links of their data blocks."""
    disks = _written_images(spark, sf_dir).where(b.u8(F.col("content"), 3) % 2 == 0)
    return volume.files(disks, pointers=False).select("disk_id", "path", F.md5("content").alias("md5"))


@query(f"WITH {_MADE} SELECT disk_id, maps AS blocks, maps * 4064 AS bits, {_FREE} AS free FROM made")
def image_bitmaps(spark, sf_dir):
    bits = volume.bitmap(_written_images(spark, sf_dir))
    return bits.groupBy("disk_id").agg((F.max("blk_idx") + 1).cast("bigint").alias("blocks"), F.count("*").alias("bits"), F.sum("free").cast("bigint").alias("free"))


@query(f"""
    WITH {_MADE}, n AS (SELECT disk_id, count(*) AS files, sum(heads - 1) AS lists, sum(CASE WHEN ffs THEN 0 ELSE data END) AS data FROM files GROUP BY 1),
    kinds AS (SELECT disk_id, unnest(['BOOTBLOCK', 'ROOTBLOCK', 'BITMAP BLOCK', 'HEADER', 'LIST', 'DATA BLOCK', 'EMPTY']) AS sector_type, unnest([1, 1, maps, files + folders, lists, data, sectors - 2 - maps - files - folders - lists - data]) AS sectors FROM made JOIN n USING (disk_id))
    SELECT disk_id, sector_type, CAST(sectors AS BIGINT) AS sectors FROM kinds WHERE sectors > 0""")
def image_sector_types(spark, sf_dir):
    disks = _written_images(spark, sf_dir)
    return volume.sector_types(disks, images.sectors(disks)).groupBy("disk_id", "sector_type").agg(F.count("*").alias("sectors"))


@query(f"WITH {_MADE} SELECT disk_id, CAST(CASE WHEN 2 + blocks < sectors // 2 THEN 2 + blocks ELSE 3 + blocks + maps END AS INTEGER) AS sector FROM made")
def image_first_free(spark, sf_dir):
    return volume.first_free(_written_images(spark, sf_dir))


@query(f"WITH {_MADE} SELECT disk_id, sectors, {_FREE} AS empty FROM made")
def image_empty_blocks(spark, sf_dir):
    """Each sector's bit looked up."""
    disks = _written_images(spark, sf_dir)
    asked = volume.is_empty(disks, images.sectors(disks).select("disk_id", "sector"))
    return asked.groupBy("disk_id").agg(F.count("*").alias("sectors"), F.count_if("empty").alias("empty"))


@query(f"WITH {_MADE} SELECT DISTINCT disk_id, source AS folder, CAST(sectors // 2 AS INTEGER) AS parent_sector FROM files JOIN made USING (disk_id)")
def image_parents(spark, sf_dir):
    entries = volume.dir_entries(_written_images(spark, sf_dir))
    return volume.parent_entry(entries).select("disk_id", "folder", "parent_sector")


@query(f"SELECT disk_id, 'doc' || doc_id AS name, 'doc' || lead(doc_id) OVER (PARTITION BY disk_id, source, {_bucket_sql("'doc' || doc_id")} ORDER BY doc_id) AS predecessor FROM ({_IMAGE_SQL})")
def image_chains(spark, sf_dir):
    """The entry whose hash chain link leads to each file; new entries are put in front."""
    found = volume.chains(_written_images(spark, sf_dir))
    return found.where("type_string = 'FILE'").select("disk_id", "name", F.col("predecessor_name").alias("predecessor"))


@query(f"""
    WITH e AS (SELECT disk_id, source AS path, 'DIR' AS type_string FROM ({_IMAGE_SQL}) GROUP BY ALL UNION ALL SELECT disk_id, source || '/doc' || doc_id, 'FILE' FROM ({_IMAGE_SQL}))
    SELECT *, disk_id || '/' || path AS shown FROM e""")
def image_paths(spark, sf_dir):
    disks = _written_images(spark, sf_dir)
    return volume.display_path(volume.disk_info(disks), volume.tree(disks)).select("disk_id", "path", "type_string", "shown")


@query(f"""
    WITH e AS (SELECT disk_id, '' AS folder, 0 AS kind, source AS name FROM ({_IMAGE_SQL}) GROUP BY ALL UNION ALL SELECT disk_id, source, 1, 'doc' || doc_id FROM ({_IMAGE_SQL}))
    SELECT disk_id, folder, name, CAST(row_number() OVER (PARTITION BY disk_id, folder ORDER BY kind, name) AS INTEGER) AS position FROM e""")
def image_positions(spark, sf_dir):
    """Folders' entries in the order that a viewer shows them."""
    shown = volume.listing(volume.dir_entries(_written_images(spark, sf_dir)))
    return shown.select("disk_id", F.col("dir_name").alias("folder"), "name", "position")


def _changes(spark, sf_dir) -> DataFrame:
    """Every third file deleted, the next ones renamed, then every folder deleted if it is empty; with the results of the requests."""
    held = _image_files(spark, sf_dir)
    path, last = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string")), F.lit(10**12)
    none = F.lit(None).cast("binary")
    gone = held.where("doc_id % 3 = 0").select("disk_id", F.col("doc_id").alias("seq"), F.lit("delete").alias("op"), path.alias("path"), F.lit(None).cast("string").alias("name"), none.alias("content"))
    named = held.where("doc_id % 3 = 1").select("disk_id", F.col("doc_id").alias("seq"), F.lit("rename").alias("op"), path.alias("path"), F.concat(F.lit("text"), F.col("doc_id").cast("string")).alias("name"), none.alias("content"))
    folders = held.select("disk_id", last.alias("seq"), F.lit("delete").alias("op"), F.col("source").alias("path"), F.lit(None).cast("string").alias("name"), none.alias("content")).distinct()
    return write.apply(_written_images(spark, sf_dir), gone.unionByName(named).unionByName(folders))


@query(f"SELECT disk_id, source || CASE WHEN doc_id % 3 = 1 THEN '/text' ELSE '/doc' END || doc_id AS path, md5(text) AS md5 FROM ({_IMAGE_SQL}) WHERE doc_id % 3 > 0")
def image_changes(spark, sf_dir):
    """What is left after files were deleted and renamed and empty folders deleted."""
    return volume.files(images.described(_changes(spark, sf_dir).select("disk_id", "content"))).select("disk_id", "path", F.md5("content").alias("md5"))


@query(f"""
    WITH f AS (SELECT disk_id, source, max(doc_id % 3) AS left_ FROM ({_IMAGE_SQL}) GROUP BY ALL)
    SELECT disk_id, doc_id AS seq, CAST(NULL AS VARCHAR) AS error FROM ({_IMAGE_SQL}) WHERE doc_id % 3 < 2
    UNION ALL SELECT disk_id, 1000000000000, CASE WHEN left_ > 0 THEN 'folder is not empty' END FROM f""")
def image_change_results(spark, sf_dir):
    """What each request came to."""
    return _changes(spark, sf_dir).select("disk_id", F.explode("results").alias("r")).select("disk_id", "r.seq", "r.error")


@query(f"""
    WITH {_MADE}, f AS (SELECT disk_id, source, max(doc_id % 3) AS left_, sum(CASE WHEN doc_id % 3 = 0 THEN data + heads ELSE 0 END) AS freed FROM files GROUP BY ALL),
    back AS (SELECT disk_id, CAST(sum(freed) + count(CASE WHEN left_ = 0 THEN 1 END) AS BIGINT) AS freed FROM f GROUP BY 1)
    SELECT disk_id, {_FREE} + freed AS free_blocks FROM made JOIN back USING (disk_id)""")
def image_changes_space(spark, sf_dir):
    """The space that deletions gave back."""
    return volume.free_size(images.described(_changes(spark, sf_dir).select("disk_id", "content")), strict=True).select("disk_id", "free_blocks")


@query(f"SELECT disk_id, 'empty-' || n AS folder FROM (SELECT DISTINCT disk_id, unnest(range(7)) AS n FROM ({_IMAGE_SQL}))")
def image_empty_folders(spark, sf_dir):
    """Seven empty folders on each image."""
    disks = _written_images(spark, sf_dir)
    one = _image_files(spark, sf_dir).select("disk_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(6))))
    asked = one.select("disk_id", F.col("n").cast("bigint").alias("seq"), F.lit("mkdir").alias("op"), F.lit("").alias("path"), F.concat_ws("-", F.lit("empty"), "n").alias("name"), F.lit(None).cast("binary").alias("content"))
    made = images.described(write.apply(disks, asked).select("disk_id", "content"))
    return volume.empty_folders(made).select("disk_id", F.col("name").alias("folder"))


# Raw disks


def _pages(spark, sf_dir) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("disk_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return raw.withColumn("sector_count", F.expr("CAST(octet_length(content) DIV 512 AS INT)"))


_READS = [("range", 5, 100), ("sector", 512, 512), ("track", 0, 11 * 512), ("cylinder", 0, 22 * 512), ("boot block", 0, 1024), ("boot track", 1024, 9 * 512)]


@query(" UNION ALL ".join(f"SELECT CAST(page_id AS VARCHAR) AS disk_id, '{name}' AS part, md5(substr(hex(encode(coalesce(html, ''))), {2 * at + 1}, {2 * n})) AS md5 FROM pages" for name, at, n in _READS))
def disk_reads(spark, sf_dir):
    """Bytes, sectors, tracks, cylinders and boot sectors of raw disks."""
    disks = _pages(spark, sf_dir)
    parts = [images.read_range(disks, 5, 100), images.read_sectors(disks, 1), images.track(disks), images.cylinder(disks), images.boot_block(disks), images.boot_track(disks)]
    out = None
    for (name, *_), part in zip(_READS, parts, strict=True):
        one = part.select("disk_id", F.lit(name).alias("part"), F.md5(F.hex("data")).alias("md5"))
        out = one if out is None else out.unionByName(one)
    return out


_SECTORS_SQL = "(SELECT CAST(page_id AS VARCHAR) AS disk_id, CAST(sector AS INTEGER) AS sector, substr(h, sector * 1024 + 1, 1024) AS data FROM (SELECT page_id, hex(encode(html)) AS h, unnest(range(octet_length(encode(html)) // 512)) AS sector FROM pages))"


@query(f"SELECT disk_id, sector, md5(CASE sector WHEN 0 THEN rpad(hex(encode('patch' || disk_id)), 1024, '0') WHEN 1 THEN repeat('0', 1024) ELSE data END) AS md5 FROM {_SECTORS_SQL}")
def sector_writes(spark, sf_dir):
    """The first sector of each raw disk overwritten, the second cleared."""
    sectors = images.sectors(_pages(spark, sf_dir))
    patch = sectors.where("sector = 0").withColumn("data", F.encode(F.concat(F.lit("patch"), "disk_id"), "UTF-8"))
    done = overlay.clear_sectors(overlay.write_sectors(sectors, patch), sectors.where("sector = 1"))
    return done.select("disk_id", "sector", F.md5(F.hex("data")).alias("md5"))


@query(f"SELECT disk_id, md5(string_agg(data, '' ORDER BY sector)) AS md5 FROM {_SECTORS_SQL} GROUP BY 1")
def disk_assembly(spark, sf_dir):
    """Disks put together from their sectors."""
    return images.assemble(images.sectors(_pages(spark, sf_dir))).select("disk_id", F.md5(F.hex("content")).alias("md5"))


def _chars_sql(h: str, spaced: bool) -> str:
    one = f"chr(CAST('0x' || substr({h}, 2 * i + 1, 2) AS INTEGER))" + (" || ' ' || CASE WHEN i % 16 = 15 AND 2 * i + 2 < length(" + h + ") THEN chr(10) ELSE '' END" if spaced else "")
    return f"array_to_string(list_transform(range(length({h}) // 2), lambda i: {one}), '')"


@query(f"""
    WITH s AS (SELECT s.*, count(*) OVER (PARTITION BY disk_id) AS n FROM {_SECTORS_SQL} AS s)
    SELECT disk_id, sector, array_to_string(list_transform(range(32), lambda i: trim(regexp_replace(substr(data, i * 32 + 1, 32), '(..)', '\\1 ', 'g'))), chr(10)) AS hex, {_chars_sql("data", True)} AS ascii
    FROM s WHERE sector = least(2, n - 1)""")
def sector_dumps(spark, sf_dir):
    """The third sector of each raw disk, or its last, as a viewer shows it."""
    return volume.sector_dump(_pages(spark, sf_dir), 2)


def _int_sql(h: str, at: str, n: int, little: bool = False, signed: bool = False) -> str:
    part = f"substr({h}, 2 * ({at}) + 1, {2 * n})"
    if little:
        part = " || ".join(f"substr({part}, {2 * k + 1}, 2)" for k in reversed(range(n)))
    value = f"CASE WHEN length({h}) >= 2 * ({at}) + {2 * n} THEN CAST('0x' || {part} AS BIGINT) END"
    return f"(CASE WHEN {value} >= {1 << (8 * n - 1)} THEN {value} - {1 << (8 * n)} ELSE {value} END)" if signed else f"({value})"


_AT = "(page_id % 90)"


def _at() -> Column:
    return (F.col("id") % 90).cast("int")


@query(f"""
    SELECT page_id, {_int_sql("h", _AT, 1)} AS u8, {_int_sql("h", _AT, 1, signed=True)} AS s8, {_int_sql("h", _AT, 2)} AS u16, {_int_sql("h", _AT, 2, True)} AS u16le, {_int_sql("h", _AT, 2, signed=True)} AS s16,
        {_int_sql("h", _AT, 4)} AS u32, {_int_sql("h", _AT, 4, True)} AS u32le, md5(substr(h, 2 * {_AT} + 1, 40)) AS bytes_, {_chars_sql(f"substr(h, 2 * {_AT} + 1, 24)", False)} AS latin1,
        {_chars_sql(f"substr(h, 2 * {_AT} + 3, 2 * {_int_sql('h', _AT, 1)})", False)} AS pascal,
        ({_int_sql("h", f"{_AT} // 8", 2)} >> CAST(11 - {_AT} % 8 AS BIGINT)) & 31 AS bits, lpad(bin({_int_sql("h", _AT, 1)}), 8, '0') AS byte_bits, least({_AT}, octet_length(encode(html)) - 1) AS clamped, page_id % 900 >= octet_length(encode(html)) - 200 AS at_end
    FROM (SELECT page_id, html, hex(encode(html)) AS h FROM pages)""")
def binary_reads(spark, sf_dir):
    """Typed reads at changing offsets of the pages' bytes."""
    held = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("d"))
    d, at = F.col("d"), _at()
    return held.select(
        F.col("id").alias("page_id"), b.u8(d, at).alias("u8"), b.s8(d, at).alias("s8"), b.u16(d, at).alias("u16"), b.u16(d, at, little=True).alias("u16le"), b.s16(d, at).alias("s16"), b.u32(d, at).alias("u32"), b.u32(d, at, little=True).alias("u32le"),
        F.md5(F.hex(b.read_bytes(d, at, 20))).alias("bytes_"), b.latin1(d, at, 12).alias("latin1"), b.pascal(d, at).alias("pascal"), b.bits(d, 5, at).cast("bigint").alias("bits"), b.byte_bits(b.u8(d, at)).alias("byte_bits"), b.clamp(at, F.octet_length(d)).cast("bigint").alias("clamped"), b.at_end(F.col("id") % 900, F.octet_length(d), 200).alias("at_end"),
    )


@query("""
    SELECT c_custkey, lpad(hex(c_custkey % 256), 2, '0') AS one, lpad(hex(65536 - 1 - c_custkey % 30000), 4, '0') AS two, substr(lpad(hex(c_custkey), 8, '0'), 7, 2) || substr(lpad(hex(c_custkey), 8, '0'), 5, 2) || substr(lpad(hex(c_custkey), 8, '0'), 3, 2) || substr(lpad(hex(c_custkey), 8, '0'), 1, 2) AS four_little,
        hex(encode(c_name)) AS text, rpad(hex(encode(substr(c_name, 1, 12))), 24, '0') AS section, repeat('AB', 7) AS filled, c_custkey % 256 AS back FROM customer""")
def binary_writes(spark, sf_dir):
    """Typed writes."""
    c, name = F.col("c_custkey"), F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.hex(b.put(c, 1)).alias("one"), F.hex(b.put(-1 - c % 30000, 2)).alias("two"), F.hex(b.put(c, 4, little=True)).alias("four_little"), F.hex(b.put_latin1(name)).alias("text"),
        F.hex(b.put_section(name, 12)).alias("section"), F.hex(b.filled(7, 0xAB)).alias("filled"), b.bits_value(b.byte_bits(c % 256)).alias("back"),
    )


@query("SELECT (c_custkey - 1) // 4064 AS block, CAST((c_custkey - 1) % 4064 // 32 AS INTEGER) AS word, CAST(sum(CASE WHEN c_custkey % 7 <> 0 THEN CAST(1 AS BIGINT) << CAST((c_custkey - 1) % 32 AS INTEGER) ELSE 0 END) AS BIGINT) AS value FROM customer GROUP BY ALL")
def bitmap_words(spark, sf_dir):
    """Free flags of customers as the longs of bitmap blocks; every seventh is in use."""
    bits = table(spark, sf_dir, "customer").select(F.expr("(c_custkey - 1) DIV 4064").alias("block"), F.expr("(c_custkey - 1) % 4064").alias("bit_idx"), F.when(F.col("c_custkey") % 7 != 0, 1).otherwise(0).alias("free"))
    return encode.packed_longs(bits, ["block"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND octet_length(encode(text)) > 16 THEN 'MOD' END AS file_type FROM documents")
def type_modules(spark, sf_dir):
    """Documents behind 1,080 bytes and a module's tag, or another tag."""
    tag = F.element_at(F.array(*map(F.lit, ("M.K.", "8CHN", "NONE"))), (F.col("doc_id") % 3 + 1).cast("int"))
    data = F.concat(b.filled(1080, 0x20), b.put_latin1(tag), content())
    return table(spark, sf_dir, "documents").select("doc_id", detect.detect(data).alias("file_type"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'containing ' || doc_id % 60000 || ' sprites' WHEN 1 THEN 'icon' END AS info FROM documents")
def type_info(spark, sf_dir):
    """What the handlers say about sprite banks, icons and archives."""
    n = b.put(F.col("doc_id") % 60000, 2)
    kind = F.col("doc_id") % 3
    data = F.when(kind == 0, F.concat(F.lit(b"AmSp"), n, content())).when(kind == 1, F.concat(F.lit(b"\xe3\x10"), content())).otherwise(F.concat(F.lit(b"DMS!"), content()))
    return table(spark, sf_dir, "documents").select("doc_id", detect.inspect(data).alias("info"))


# Archives: a document is a disk, or several if it does not fit one; all modes of packing take turns.
_DISK = archive.TRACKS * archive.TRACK_BYTES
_TASK = 1 << 24  # bytes of the input's files that a task packs at most, about
_PARTS_SQL = f"(SELECT doc_id || '-' || part AS archive_id, doc_id % 7 AS mode, substr(h, part * {2 * _DISK} + 1, {2 * _DISK}) AS h FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(CAST(ceil(octet_length(encode(text)) / {_DISK}.0) AS BIGINT))) AS part FROM documents))"


def _archives(spark, sf_dir, password: str | None = None) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = documents.select("doc_id", content().alias("content")).where(F.octet_length("content") > 0)
    cut = held.select("doc_id", F.posexplode(images.cut_sectors(F.col("content"), F.ceil(F.octet_length("content") / _DISK).cast("int"), _DISK)).alias("part", "content"))
    disks = cut.select(F.concat_ws("-", "doc_id", "part").alias("archive_id"), (F.col("doc_id") % 7).cast("int").alias("mode"), "content")
    # packing takes much longer than reading, so it is dealt out in more parts than files have; the more input, the more parts
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return archive.from_images(disks.repartition(max(4 * spark.sparkContext.defaultParallelism, -(-size // _TASK)), "archive_id"), password)


@query(f"SELECT archive_id, CAST(mode AS BIGINT) AS mode, CAST(ceil(length(h) / {2.0 * archive.TRACK_BYTES}) AS BIGINT) * {archive.TRACK_BYTES} AS unpacked, 'ok' AS status FROM {_PARTS_SQL}")
def archive_headers(spark, sf_dir):
    return archive.archive_headers(_archives(spark, sf_dir)).select("archive_id", "mode", "unpacked", "status")


@query(f"""
    SELECT archive_id, CAST(number AS INTEGER) AS number, CAST(mode AS INTEGER) AS mode, {archive.TRACK_BYTES} AS unpacked, 'ok' AS status, md5(rpad(substr(h, number * {2 * archive.TRACK_BYTES} + 1, {2 * archive.TRACK_BYTES}), {2 * archive.TRACK_BYTES}, '0')) AS md5
    FROM (SELECT *, unnest(range(CAST(ceil(length(h) / {2.0 * archive.TRACK_BYTES}) AS BIGINT))) AS number FROM {_PARTS_SQL})""")
def archive_tracks(spark, sf_dir):
    """Tracks unpacked, their checks held."""
    found = archive.archive_tracks(_archives(spark, sf_dir))
    return found.select("archive_id", "number", "mode", "unpacked", "status", F.md5(F.hex("data")).alias("md5"))


_TRACKS_SQL = f"(SELECT archive_id, mode, CAST(number AS INTEGER) AS number, md5(rpad(substr(h, number * {2 * archive.TRACK_BYTES} + 1, {2 * archive.TRACK_BYTES}), {2 * archive.TRACK_BYTES}, '0')) AS md5 FROM (SELECT *, unnest(range(CAST(ceil(length(h) / {2.0 * archive.TRACK_BYTES}) AS BIGINT))) AS number FROM {_PARTS_SQL}))"


def _disk_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks of disk images, with their md5."""
    return tracks.where("number IS NOT NULL").withColumn("md5", F.md5(F.hex("data"))).drop("data", "problem")


@query(f"SELECT archive_id, 'ok' AS status, {_DISK} AS size, number, md5 FROM {_TRACKS_SQL}")
def archive_images(spark, sf_dir):
    """Archives unpacked to disk images."""
    return _disk_tracks(archive.image_tracks(_archives(spark, sf_dir)))


@query(f"SELECT archive_id, 'encrypted' AS flags, 'ok' AS status, {_DISK} AS size, number, md5, 'wrong password' AS otherwise FROM {_TRACKS_SQL}")
def archive_encrypted(spark, sf_dir):
    """Encrypted archives with their password and with another one."""
    small_batches(spark)  # archives go to Python three times more
    held = _archives(spark, sf_dir, "secret").withColumn("archive", F.col("content"))
    # each step keeps the archive beside what it finds, so archives are made once and nothing is joined
    flags = archive.archive_headers(held, key=("archive_id", "archive"))
    flags = flags.select("archive_id", F.array_join("flags", ",").alias("flags"), "archive", F.col("archive").alias("content"))
    bad = archive.image_status(flags, "guess", key=("archive_id", "flags", "archive"))
    bad = bad.select("archive_id", "flags", F.col("status").alias("otherwise"), F.col("archive").alias("content"))
    return _disk_tracks(archive.image_tracks(bad, "secret", key=("archive_id", "flags", "otherwise"), blank=True))


# Pictures of one plane, 64 pixels wide: a document's bytes are the lines; odd ones are packed.
_LINES = "CAST(ceil(octet_length(encode(text)) / 8.0) AS BIGINT)"


def _pictures(spark, sf_dir) -> DataFrame:
    held = table(spark, sf_dir, "documents").select("doc_id", content().alias("c")).where(F.octet_length("c").between(1, 8 * 65535))
    lines = F.ceil(F.octet_length("c") / 8)
    raw = F.rpad("c", (lines * 8).cast("int"), F.lit(b"\0"))
    packed = F.unhex(F.regexp_replace(F.hex(raw), "(.{16})", "07$1"))  # a literal of eight bytes each
    odd = F.col("doc_id") % 2
    body = F.when(odd == 1, packed).otherwise(raw)
    chunk = lambda name, data: F.concat(F.lit(name), b.put(F.octet_length(data), 4), data, F.when(F.octet_length(data) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))
    head = F.concat(b.put(64, 2), b.put(lines, 2), b.filled(4), b.put(1, 1), b.put(0, 1), b.put(odd, 1), b.put(0, 1), b.put(0, 2), b.put(10, 1), b.put(11, 1), b.put(64, 2), b.put(lines, 2))
    parts = F.concat(F.lit(b"ILBM"), chunk(b"BMHD", head), chunk(b"CMAP", F.lit(b"\x00\x00\x00\xff\xff\xff")), chunk(b"BODY", body))
    return held.select(F.col("doc_id").cast("string").alias("disk_id"), F.lit(0).alias("sector"), F.concat(F.lit(b"FORM"), b.put(F.octet_length(parts), 4), parts).alias("content"))


_PICTURE_SQL = f"(SELECT doc_id, CAST(doc_id AS VARCHAR) AS disk_id, {_LINES} AS lines, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) BETWEEN 1 AND {8 * 65535})"


def _pixels_sql(h: str, zero: str, one: str) -> str:
    """The colours of the bits of hexadecimal text, by one replacement for each digit."""
    out = f"translate({h}, '0123456789ABCDEF', 'ghijklmnopqrstuv')"
    for k in range(16):
        out = f"replace({out}, '{'ghijklmnopqrstuv'[k]}', '{''.join(one if k >> j & 1 else zero for j in (3, 2, 1, 0))}')"
    return out


@query(f"SELECT disk_id, 64 AS width, CAST(lines AS INTEGER) AS height, 1 AS planes, CAST(doc_id % 2 AS INTEGER) AS compression, 2 AS colours FROM {_PICTURE_SQL}")
def picture_headers(spark, sf_dir):
    return iff.pictures(_pictures(spark, sf_dir)).select("disk_id", "width", "height", "planes", "compression", "colours")


@query(f"SELECT disk_id, md5({_pixels_sql("rpad(h, CAST(lines * 16 AS INTEGER), '0')", '000000', 'FFFFFF')}) AS md5 FROM {_PICTURE_SQL}")
def picture_rasters(spark, sf_dir):
    """Planes, packed or not, turned to colours."""
    return iff.rasters(_pictures(spark, sf_dir)).select("disk_id", F.md5(F.hex("rgb")).alias("md5"))


@query(f"SELECT disk_id, CAST(seq AS INTEGER) AS seq, chunk, size FROM (SELECT disk_id, unnest([0, 1, 2]) AS seq, unnest(['BMHD', 'CMAP', 'BODY']) AS chunk, unnest([20, 6, lines * (8 + doc_id % 2)]) AS size FROM {_PICTURE_SQL})")
def picture_chunks(spark, sf_dir):
    return iff.chunks(_pictures(spark, sf_dir)).select("disk_id", "seq", "chunk", "size")


# Icons: even documents hold their bytes as a plane 64 pixels wide, odd ones a colour state of two pixels.
_ICON_LINES = 500


def _icons(spark, sf_dir) -> DataFrame:
    held = table(spark, sf_dir, "documents").select("doc_id", content().alias("c")).where(F.octet_length("c").between(1, 8 * _ICON_LINES))
    lines = F.ceil(F.octet_length("c") / 8)
    odd = F.col("doc_id") % 2 == 1
    zeros = lambda n: b.filled(n)
    text = lambda s: F.concat(b.put(F.octet_length(s) + 1, 4), s, zeros(1))
    tool, tip = b.put_latin1(F.concat(F.lit("SYS:Tool"), F.col("doc_id").cast("string"))), b.put_latin1(F.concat(F.lit("NUMBER="), F.col("doc_id").cast("string")))
    # magic, version, link, edges, size, then a pointer to the image; type, default tool, tool types, place, stack
    head = F.concat(b.put(0xE310, 2), b.put(1, 2), zeros(8), b.put(64, 2), b.put(lines, 2), zeros(6), b.put(1, 4), zeros(4), zeros(12), zeros(2), zeros(4), b.put(4, 1), zeros(1), b.put(1, 4), b.put(1, 4), b.put(F.col("doc_id") % 1000, 4), b.put(7, 4), zeros(8), b.put(4096, 4))
    plane = F.concat(zeros(4), b.put(64, 2), b.put(lines, 2), b.put(1, 2), b.put(1, 4), b.put(1, 1), zeros(1), zeros(4), F.rpad("c", (lines * 8).cast("int"), F.lit(b"\0")))
    types = F.concat(b.put(12, 4), text(tip), text(F.lit(b"B")))
    state = F.concat(F.lit(b"ICONFACE"), b.put(6, 4), b.put(1, 1), zeros(5), F.lit(b"IMAG"), b.put(18, 4), zeros(2), b.put(2, 1), zeros(2), b.put(8, 1), b.put(1, 2), b.put(5, 2), F.lit(bytes([1, 1, 1, 2, 3, 9, 8, 7])))
    form = F.concat(F.lit(b"FORM"), b.put(F.octet_length(state), 4), state)
    whole = F.concat(head, plane, text(tool), types, F.when(odd, form).otherwise(F.lit(b"")))
    return held.select(F.col("doc_id").cast("string").alias("disk_id"), F.lit(0).alias("sector"), whole.alias("content"))


_ICON_SQL = f"(SELECT doc_id, CAST(doc_id AS VARCHAR) AS disk_id, {_LINES} AS lines, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) BETWEEN 1 AND {8 * _ICON_LINES})"
@query(f"SELECT disk_id, CAST(lines AS INTEGER) AS height, CAST(doc_id % 1000 AS BIGINT) AS current_x, 'SYS:Tool' || doc_id AS default_tool, 'NUMBER=' || doc_id || ' B' AS tool_types, CAST(doc_id % 2 AS INTEGER) AS colour_states FROM {_ICON_SQL}")
def icon_headers(spark, sf_dir):
    from sectorlake.operators import icon

    return icon.icons(_icons(spark, sf_dir)).select("disk_id", "height", "current_x", "default_tool", F.array_join("tool_types", " ").alias("tool_types"), "colour_states")


@query(f"""
    SELECT disk_id, CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 64 END AS width, CASE WHEN doc_id % 2 = 1 THEN md5('090807FF090807FF')
        ELSE md5({_pixels_sql("rpad(h, CAST(lines * 16 AS INTEGER), '0')", '55AAFF00', 'FFFFFFFF')}) END AS md5 FROM {_ICON_SQL}""")
def icon_rasters(spark, sf_dir):
    """What is shown of icons: a colour state, or the plane in the fixed colours."""
    from sectorlake.operators import icon

    return icon.rasters(_icons(spark, sf_dir)).select("disk_id", "width", F.md5(F.hex("rgba")).alias("md5"))


# More of volumes, and what viewers show


@query(f"SELECT DISTINCT disk_id, source AS name, CAST({_bucket_sql('source')} AS INTEGER) AS bucket FROM ({_IMAGE_SQL})")
def image_roots(spark, sf_dir):
    """The entries of the root folders."""
    return volume.dir_entries(_written_images(spark, sf_dir), 0).select("disk_id", "name", "bucket")


@query(f"WITH {_MADE} SELECT disk_id, count(*) + any_value(folders) + 1 AS headers, true AS same FROM files JOIN made USING (disk_id) GROUP BY 1")
def image_rewrites(spark, sf_dir):
    """Headers decoded, encoded again and compared with what was read."""
    sectors = images.sectors(_written_images(spark, sf_dir))
    return volume.rewrite_blocks(sectors).groupBy("disk_id").agg(F.count("*").alias("headers"), F.every(F.col("data") == F.col("read")).alias("same"))


@query("SELECT * FROM (VALUES (2, 'IFF', 'IFF file', true), (3, 'ILBM', 'ILBM Image', true), (4, 'ANIM', 'IFF ILBM Animation', true), (5, 'MOD', 'Module', false), (6, 'AMBK', 'Picture bank', true), (7, 'AMSP', 'Sprite bank', true), (8, 'AMIC', 'Icon bank', true), (9, 'ICON', 'Icon file', true), (10, 'DMS', 'Disk archive', false)) AS t(number, type, name, inspectable)")
def type_table(spark, sf_dir):
    """The registered types."""
    return detect.file_types(spark).select("number", "type", "name", "inspectable")


_MARKED = "(SELECT doc_id, disk_id, source, CASE doc_id % 4 WHEN 0 THEN 'AMSP' WHEN 1 THEN 'ICON' WHEN 2 THEN 'DMS' END AS type FROM ({0}))".format(_IMAGE_SQL)


@query(f"SELECT disk_id, type, CASE type WHEN 'AMSP' THEN 'containing 16705 sprites' WHEN 'ICON' THEN 'icon' END AS info, count(*) AS files FROM {_MARKED} GROUP BY ALL")
def image_types(spark, sf_dir):
    """The types of the files of images, by their first bytes; each file's content starts with one that its number chooses."""
    files = volume.files(_written_images(spark, sf_dir))
    kind = F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint") % 4
    first = F.when(kind == 0, F.lit(b"AmSpAA")).when(kind == 1, F.lit(b"\xe3\x10")).when(kind == 2, F.lit(b"DMS!")).otherwise(F.lit(b"\0"))
    found = detect.detect_files(files.withColumn("content", F.concat(first, "content")))
    return found.groupBy("disk_id", "type", "info").agg(F.count("*").alias("files"))


_STAMP = "(SELECT doc_id, octet_length(encode(text)) AS n, TIMESTAMP '1978-01-01' + to_days(CAST(doc_id % 5000 AS INTEGER)) + to_minutes(CAST(doc_id % 1440 AS BIGINT)) AS t FROM documents)"
_DAY_SQL = "strftime(t, '%-d') || ' ' || lower(strftime(t, '%b')) || ' ' || strftime(t, '%Y %H:%M')"


@query(f"SELECT doc_id, {_DAY_SQL} AS shown, strftime(make_timestamp(doc_id * 1000003 * 1000000), '%-d %b %Y %-H:%-M:%-S') AS unix FROM {_STAMP}")
def display_dates(spark, sf_dir):
    from sectorlake.functions import formats

    days, minutes = F.col("doc_id") % 5000, F.col("doc_id") % 1440
    return table(spark, sf_dir, "documents").select("doc_id", formats.date_text(days, minutes, F.lit(75)).alias("shown"), formats.unix_date_text(F.col("doc_id") * 1000003).alias("unix"))


@query(f"""
    SELECT doc_id, 'doc' || doc_id AS name, CASE WHEN n > 0 THEN CASE WHEN n < 1024 THEN n || ' bytes' ELSE CAST(floor(n / 1024.0 + 0.5) AS BIGINT) || ' kb' END END AS size, CASE WHEN doc_id % 3 > 0 THEN repeat('c', CAST(doc_id % 3 AS INTEGER)) END AS comment,
        CASE WHEN doc_id % 5000 > 1000 THEN {_DAY_SQL} END AS last_changed, CASE WHEN doc_id % 2 = 0 THEN 'This is an ILBM' ELSE 'This is a Module' END AS article,
        CASE WHEN n < 1024 THEN '<b>' || greatest(n, 1) || '</b> bytes' ELSE '<b>' || CAST(floor(n / 1024.0 + 0.5) AS BIGINT) || '</b> kb' END AS markup, lpad(hex(doc_id % 256), 2, '0') AS hex_byte
    FROM {_STAMP} WHERE n < 1000000""")
def display_panel(spark, sf_dir):
    """What a viewer lists about a file."""
    from sectorlake.functions import formats

    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(content()).cast("bigint").alias("n")).where("n < 1000000")
    i = F.col("doc_id")
    panel = formats.info_panel(F.concat(F.lit("doc"), i.cast("string")), F.lit("FILE"), F.col("n"), F.repeat(F.lit("c"), (i % 3).cast("int")), i % 5000, i % 1440, F.lit(0))
    kind = formats.article(F.when(i % 2 == 0, "ILBM").otherwise("Module"))
    return docs.select("doc_id", panel.alias("p"), kind.alias("article"), formats.disk_size_markup(F.col("n")).alias("markup"), formats.hex_byte(i % 256).alias("hex_byte")).select("doc_id", "p.name", "p.size", "p.comment", "p.last_changed", "article", "markup", "hex_byte")
