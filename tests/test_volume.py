import random
import struct

import pytest
from pyspark.sql import functions as F

from sectorlake.functions import binary as b, blocks, encode
from sectorlake.functions.image import Image, blank
from sectorlake.operators import catalogue, detect, overlay, volume, write
from sectorlake.sources import images as src, sinks
from sectorlake.streaming import watch
from tests import walker


def make(ffs, label):
    im = Image(blank(label=label, ffs=ffs))
    r = random.Random(label)
    sub = im.create_folder("sub", stamp=(5000, 61, 50))
    deep = im.create_folder("deep", sub)
    im.write_file("readme", b"hello", stamp=(7000, 600, 149))
    im.write_file("big", r.randbytes(488 * 150 + 3), sub)
    im.write_file("pic", b"FORM" + struct.pack(">I", 4) + b"ILBM" + b"xxxx", deep)
    im.write_file("empty", b"", deep)
    return bytes(im.data)


@pytest.fixture(scope="module")
def content():
    return {"ofs": make(False, "Work"), "ffs": make(True, "Fast")}


@pytest.fixture(scope="module")
def folder(tmp_path_factory, content):
    d = tmp_path_factory.mktemp("disks")
    for k, v in content.items():
        (d / f"{k}.adf").write_bytes(v)
    bad = bytearray(content["ofs"])
    bad[880 * 512 + 3] = 9
    (d / "noroot.adf").write_bytes(bad)
    (d / "odd.adf").write_bytes(bytes(512 * 3))
    (d / "cut.adf").write_bytes(bytes(1000))
    (d / "text.adf").write_bytes((b"XXX\0" + content["ofs"][4:]))
    (d / "part.hdf").write_bytes(b"RDSK" + bytes(1020))
    return d


@pytest.fixture(scope="module")
def disks(spark, folder):
    found = src.images(spark, str(folder)).withColumn("disk_id", F.regexp_extract("path", r"([^/]+)\.\w+$", 1))
    return found.cache()


def test_rejects(disks):
    got = {r.disk_id: r.reject_reason for r in disks.select("disk_id", "reject_reason").collect()}
    assert got == {"ofs": None, "ffs": None, "part": None, "noroot": "no root block", "odd": "odd number of sectors", "cut": "size is not a whole number of sectors", "text": "not a DOS disk"}


def test_info_and_space(disks, content):
    rows = {r.disk_id: r for r in volume.disk_info(disks).collect()}
    assert (rows["ofs"].disk_type, rows["ffs"].disk_type, rows["part"].disk_type, rows["noroot"].disk_type) == ("OFS", "FFS", "Partitioned", "UNKNOWN")
    assert rows["ofs"].label == "Work" and rows["part"].label is None and rows["ofs"].total_size == 901120
    strict = {r.disk_id: r.free_blocks for r in volume.free_size(disks, strict=True).collect()}
    assert strict == {k: len(walker.free(v)) for k, v in content.items()}
    bits = volume.bitmap(disks).where("sector < 1760 AND free = 1").groupBy("disk_id").count().collect()
    assert {r.disk_id: r["count"] for r in bits} == strict
    assert {r.disk_id: r.sector for r in volume.first_free(disks).collect()} == {k: min(walker.free(v)) for k, v in content.items()}


def test_files_and_folders(disks, content):
    got = {(r.disk_id, r.path): bytes(r.content) for r in volume.files(disks).collect()}
    assert got == {(d, p): c for d, v in content.items() for p, c in walker.read(v)[0].items() if c is not None}
    chained = {(r.disk_id, r.path): bytes(r.content) for r in volume.files(disks, pointers=False).collect()}
    assert chained == got
    top = volume.listing(volume.dir_entries(disks, 0)).where("disk_id = 'ofs'").orderBy("position").collect()
    assert [(r.name, r.type_string) for r in top] == [("sub", "DIR"), ("readme", "FILE")]
    assert top[1].change_days == 7000
    assert {(r.path, r.type_string) for r in volume.tree(disks).where("disk_id = 'ffs'").collect()} == {("sub", "DIR"), ("sub/deep", "DIR"), ("readme", "FILE"), ("sub/big", "FILE"), ("sub/deep/pic", "FILE"), ("sub/deep/empty", "FILE")}
    n = {r.disk_id: r.n for r in volume.file_blocks(disks).groupBy("disk_id").agg(F.sum("n_bytes").alias("n")).collect()}
    assert n == {d: sum(len(c) for c in walker.read(v)[0].values() if c) for d, v in content.items()}
    assert volume.parent_entry(volume.dir_entries(disks)).where("disk_id = 'ofs'").count() == 2


def test_sectors_and_types(spark, disks, content, folder):
    sectors = src.sectors(disks.where("reject_reason IS NULL AND disk_id != 'part'"))
    assert sectors.count() == 2 * 1760
    assert {r.disk_id: bytes(r.content) for r in src.assemble(sectors).collect()} == content
    large = src.large_sectors(spark, str(folder / "ofs.adf"))
    assert large.count() == 1760 and bytes(large.where("sector = 880").first().data) == content["ofs"][880 * 512 : 881 * 512]
    kinds = {(r.disk_id, r.sector_type): r["count"] for r in volume.sector_types(disks, sectors).groupBy("disk_id", "sector_type").count().collect()}
    assert kinds["ofs", "BOOTBLOCK"] == kinds["ofs", "ROOTBLOCK"] == kinds["ofs", "BITMAP BLOCK"] == 1
    assert kinds["ofs", "HEADER"] == 6 and kinds["ofs", "DATA BLOCK"] == 151 + 1 + 1 and kinds["ofs", "LIST"] == 2
    h = {r.name: r for r in volume.headers(sectors).where("disk_id = 'ofs'").collect()}
    assert all(r.checksum_ok for r in h.values()) and h["Work"].type_string == "ROOT" and h["Work"].size is None and h["big"].size == 488 * 150 + 3
    assert str(h["readme"].changed_at) == "1997-03-02 10:00:02.980000"
    for r in volume.rewrite_blocks(sectors).collect():
        assert bytes(r.data) == content[r.disk_id][r.sector * 512 : (r.sector + 1) * 512]
    assert volume.data_blocks(sectors).where("disk_id = 'ofs' AND checksum IS NOT NULL").count() == 153
    assert volume.extension_blocks(sectors).where("NOT checksum_ok").count() == 0
    assert len(bytes(src.track(disks.where("disk_id = 'ofs'"), 80).first().data)) == 11 * 512
    assert bytes(src.cylinder(disks.where("disk_id = 'ofs'"), 40).first().data) == content["ofs"][40 * 22 * 512 : 41 * 22 * 512]
    assert len(src.boot_block(disks.where("disk_id = 'ofs'")).first().data) == 1024 and len(src.boot_track(disks.where("disk_id = 'ofs'")).first().data) == 9 * 512


def test_block_encoders(spark, content):
    payload = bytes(range(200))
    row = spark.range(1).select(
        encode.ofs_data(F.lit(payload), F.lit(7), F.lit(1), F.lit(9)).alias("d"),
        encode.extension(F.array(*(F.lit(k) for k in range(72))), F.lit(5), F.lit(3), F.lit(0)).alias("x"),
        encode.bitmap(F.array(*(F.lit(k).cast("bigint") for k in range(127)))).alias("m"),
        encode.ffs_data(F.lit(b"abc")).alias("f"),
    )
    got = row.select("*", blocks.ofs_data(F.col("d")).alias("dd"), blocks.extension(F.col("x")).alias("xx"), blocks.bitmap(F.col("m")).alias("mm")).first()
    assert bytes(got.dd.content) == payload and got.dd.next_data_block == 9
    assert got.xx.checksum_ok and got.xx.pointers == list(range(72)) and got.mm.checksum_ok and got.mm.longs == list(range(127))
    assert all(len(x) == 512 for x in (got.d, got.x, got.m, got.f)) and walker.sums_ok(bytes(got.d) + bytes(got.x) + bytes(got.m), range(3))


def test_writes(spark, disks, content):
    ops = [("ofs", 1, "mkdir", "", "new", None), ("ofs", 2, "write", "new", "x", b"data"), ("ofs", 3, "write", "new", "x", b"again"), ("ofs", 4, "rename", "new/x", "y", None), ("ofs", 5, "delete", "readme", None, None), ("ofs", 6, "delete", "nothing", None, None), ("ffs", 1, "write", "sub", "z", bytes(5000)), ("odd", 1, "write", "", "x", b"")]
    requests = spark.createDataFrame(ops, "disk_id string, seq bigint, op string, path string, name string, content binary")
    got = {r.disk_id: r for r in write.apply(disks, requests).collect()}
    files, used = walker.read(bytes(got["ofs"].content))
    assert files["new/y"] == b"data" and "readme" not in files and not used & walker.free(bytes(got["ofs"].content))
    assert [r.error for r in got["ofs"].results] == [None, None, "name exists", None, None, "no entry nothing"]
    assert walker.read(bytes(got["ffs"].content))[0]["sub/z"] == bytes(5000) and got["odd"].results[0].error
    need = spark.createDataFrame([(0,), (488,), (489,), (488 * 73,)], "n bigint").select(write.block_need(F.col("n"), F.lit(False)).alias("a"), write.block_need_compat(F.col("n"), F.lit(False)).alias("c")).collect()
    assert [r.a.total for r in need] == [1, 2, 3, 75] and need[0].c.total == 0


def test_overlays(spark):
    base = spark.createDataFrame([("d", k, bytes([k]) * 512) for k in range(4)], "disk_id string, sector int, data binary")
    patch = spark.createDataFrame([("d", 1, b"ab"), ("d", 3, b"")], "disk_id string, sector int, data binary")
    got = {r.sector: bytes(r.data) for r in overlay.write_sectors(base, patch).collect()}
    assert got == {0: bytes(512), 1: b"ab".ljust(512, b"\0"), 2: b"\x02" * 512, 3: bytes(512)}
    assert bytes(overlay.clear_sectors(base, patch.where("sector = 1")).where("sector = 1").first().data) == bytes(512)


def test_detection_order_and_catalogue(spark, disks):
    iff = b"FORM" + struct.pack(">I", 4) + b"ILBM"
    cases = {"ILBM": iff, "IFF": b"FORM" + struct.pack(">I", 4) + b"XXXX", "ANIM": b"FORM" + struct.pack(">I", 4) + b"ANIM", "MOD": bytes(1080) + b"M.K." + bytes(20), "AMBK": b"AmBk", "AMSP": b"AmSp\0\x07", "AMIC": b"AmIc", "ICON": b"\xe3\x10", "DMS": b"DMS!"}
    nothing = [b"", b"FORM", b"FORM" + struct.pack(">I", 99) + b"ILBM", bytes(1080) + b"M.K."]
    rows = [("d", k, c) for k, c in enumerate([*cases.values(), *nothing, bytes(1080) + b"32CH" + bytes(20), iff + bytes(1068) + b"M.K." + bytes(20), None])]
    got = detect.detect_files(spark.createDataFrame(rows, "disk_id string, sector int, content binary")).orderBy("sector").collect()
    assert [r.type for r in got] == [*cases, None, None, None, None, "MOD", "ILBM", None]
    assert got[list(cases).index("AMSP")].info == "containing 7 sprites" and got[list(cases).index("ICON")].info == "icon"
    assert [r.number for r in detect.file_types(spark).collect()] == list(range(2, 11))
    known = spark.createDataFrame([(disks.where("disk_id = 'ofs'").first().md5, "second"), (disks.where("disk_id = 'ofs'").first().md5, "first")], "md5 string, name string")
    out = {r.disk_id: r.outcome for r in catalogue.match(disks.drop("content"), known).collect()}
    assert out["ofs"] == "Yes: first" and out["ffs"].startswith("Nope") and out["odd"] == "This is not a standard disk image"


def test_export_and_stream(spark, disks, folder, tmp_path):
    named = disks.where("disk_id = 'ofs'").select(sinks.image_name(F.lit("Work/1"), F.col("sector_count")).alias("name"), "content")
    assert sinks.export(named, str(tmp_path / "out")) == 1
    assert (tmp_path / "out" / "Work_1.adf").read_bytes() == (folder / "ofs.adf").read_bytes()
    known = spark.createDataFrame([("x", "y")], "md5 string, name string")
    q = watch.catalogue_stream(watch.watched_images(spark, str(folder), "*.adf"), known, str(tmp_path / "s"), str(tmp_path / "c"))
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "s")).count() == 6


def test_scalars(spark):
    d = F.lit(bytes([0xFF, 0x80, 0x01, 0x02, 3, 65, 66, 0, 67]))
    got = spark.range(1).select(b.u8(d, 0), b.s8(d, 1), b.u16(d, 0), b.s16(d, 0), b.u32(d, 0), b.u16(d, 2, little=True), b.latin1(d, 5, 4), b.pascal(d, 4), b.bits(d, 4, 6), b.byte_bits(F.lit(5)), b.bits_value(F.lit("101")), b.u32(d, 7), b.clamp(99, 9), b.put(-3, 4), b.put_section(F.lit("abc"), 2), b.filled(2, 7)).first()
    assert tuple(got) == (255, -128, 0xFF80, -128, 0xFF800102, 0x0201, "AB", "AB", 0b1110, "00000101", 5, None, 8, bytearray(b"\xff\xff\xff\xfd"), bytearray(b"ab"), bytearray(b"\7\7"))
    x = bytes(random.Random(1).randbytes(300))
    from sectorlake.operators import archive

    r = spark.range(1).select(b.crc16(F.lit(x)), b.additive16(F.lit(x)), b.crc16(F.lit(b"")), b.name_hash(F.lit("")), b.name_hash(F.lit("abc"))).first()
    from sectorlake.functions.image import name_slot

    assert tuple(r) == (archive.crc16(x), archive.additive(x), 0, 0, name_slot("abc"))


def test_dump_paths_and_command_line(disks, content, folder, tmp_path, capsys):
    d = volume.sector_dump(disks.where("disk_id = 'ofs'"), 99999).first()
    assert d.sector == 1759 and d.hex.startswith("00 00") and len(d.hex.split("\n")) == 32
    assert volume.sector_dump(disks.where("disk_id = 'ofs'"), 0).first().ascii.startswith("D O S ")
    shown = {r.shown for r in volume.display_path(volume.disk_info(disks), volume.tree(disks)).collect()}
    assert "Work/sub/deep/pic" in shown and "Fast/readme" in shown
    assert "Work/pic" in {r.shown for r in volume.display_path(volume.disk_info(disks), volume.tree(disks), compat=True).collect()}
    from sectorlake.__main__ import main

    assert main(["nonsense"]) == 2 and main(["extract", str(folder)]) == 2
    for command in ("info", "list", "types", "md5"):
        assert main([command, str(folder)]) == 0
    assert "sub/deep/pic" in capsys.readouterr().out
    assert main(["extract", str(folder), str(tmp_path / "x")]) == 0
    assert (tmp_path / "x" / "ofs.adf_readme").read_bytes() == b"hello"


def test_empty_table_of_images(spark, disks):
    none = disks.where("false")
    assert volume.disk_info(none).count() == volume.files(none).count() == volume.bitmap(none).count() == src.sectors(none).count() == 0
    assert volume.empty_folders(disks).count() == 0 and volume.chain_predecessor(disks, volume.dir_entries(disks, 0).select("disk_id", "sector")).where("predecessor IS NOT NULL").count() == 0
    assert volume.is_empty(disks, spark.createDataFrame([("ofs", 0), ("ofs", 880), ("ofs", 3), ("ofs", 99999), ("ofs", 1500)], "disk_id string, sector int")).where("empty").count() == 1


def test_image_queries_write_their_images_once(spark):
    from sectorlake.plans import contract, volumes  # noqa: F401

    for name, maps, joins in (("image_types", 2, 1), ("image_listing", 2, 1), ("image_chains", 2, 1), ("image_parents", 2, 1), ("image_positions", 2, 1), ("image_rewrites", 1, 1), ("image_empty_folders", 3, 2)):
        plan = contract.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert (name, plan.count("MapInArrow"), plan.count("Join ")) == (name, maps, joins)


def test_images_come_to_python_in_small_batches(spark):
    from sectorlake import small_batches
    from sectorlake.plans import contract

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    contract.QUERIES["image_listing"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "16777216b"
    small_batches(spark, False)
    assert spark.conf.get(key) == "67108864b"
    spark.conf.set(key, "1m")  # a setting of one's own
    small_batches(spark), small_batches(spark, False)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_chains_in_one_pass_and_images_created_with_their_files(spark):
    from sectorlake.sources.images import described

    spec = spark.createDataFrame([("d", 200, "label", True)], "disk_id string, sectors int, label string, ffs boolean")
    asked = spark.createDataFrame([("d", 0, "mkdir", "", "top", None), *(("d", k, "write", "top", f"n{k}", bytearray(b"x" * k)) for k in range(1, 80)), ("d", 99, "mkdir", "", "bare", None)], "disk_id string, seq bigint, op string, path string, name string, content binary")
    one = write.create(spec, asked).collect()
    assert one == write.apply(write.format_images(spec), asked).collect() and not any(r.error for r in one[0].results)
    disks = described(spark.createDataFrame([(r.disk_id, r.content) for r in one], "disk_id string, content binary"))
    entries = volume.dir_entries(disks)
    got = {(r.sector, r.predecessor) for r in volume.chains(disks).collect()}
    assert got == {(r.sector, r.predecessor) for r in volume.chain_predecessor(disks, entries.select("disk_id", "sector")).collect()} and any(p for _, p in got)
    assert {r.dir_name for r in entries.collect()} == {"", "top"} and [r.name for r in volume.empty_folders(disks).collect()] == ["bare"]
