import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from sectorlake.functions import formats as f
from sectorlake.operators import archive, icon, iff


def test_formats(spark):
    sizes = [0, 1, 1023, 1024, 1535, 1536, 1048064, 1 << 30]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").select(f.size_text(F.col("n")), f.size_kb(F.col("n")), f.disk_size_markup(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["1 bytes", "1 bytes", "1023 bytes", "1 kb", "1 kb", "2 kb", "1 mb", "1 gb"]
    assert [r[1] for r in rows][:5] == ["1 kb", "1 kb", "1 kb", "1 kb", "1 kb"] and rows[5][2] == "<b>2</b> kb"
    day = [F.lit(x) for x in (0, 61, 75)]
    got = spark.range(1).select(f.date_text(*day), f.timestamp(*day).cast("string"), f.unix_date_text(F.lit(1_000_000_000)), f.hex_dump(F.lit(bytes(range(18)))), f.ascii_dump(F.lit(b"ab"), spaced=False), f.ascii_dump(F.lit(b"a" * 17)), f.article(F.lit("ILBM")), f.article(F.lit("Mod")), f.hex_byte(F.lit(10)), f.date_text_compat(F.lit(1), F.lit(0), F.lit(0)), f.hex_dump(F.lit(b""))).first()
    assert tuple(got) == ("1 jan 1978 01:01", "1978-01-01 01:01:01.5", "9 Sep 2001 1:46:40", "00 01 02 03 04 05 06 07 08 09 0A 0B 0C 0D 0E 0F\n10 11", "ab", "a " * 16 + "\na ", "This is an ILBM", "This is a Mod", "0A", "1 jan 1978 23:00", "")
    panel = spark.range(1).select(f.info_panel(F.lit("n"), F.lit("FILE"), F.lit(2048), F.lit(""), F.lit(900), F.lit(0), F.lit(0)).alias("p")).first().p
    assert (panel.size, panel.comment, panel.last_changed) == ("2 kb", None, None)


def chunk(name, body):
    return name + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)


def ilbm(values, planes, palette, mode=0, packed=False):
    h, w = values.shape
    line = (w + 15) // 16 * 2
    rows = []
    for y in range(h):
        for k in range(planes):
            raw = np.packbits(values[y] >> k & 1).tobytes().ljust(line, b"\0")
            if packed:  # runs and literals, with a no-op between
                raw = bytes([257 - line, raw[0]]) if len(set(raw)) == 1 else b"\x80" + bytes([line - 1]) + raw
            rows.append(raw)
    head = struct.pack(">HHhhBBBBHBBHH", w, h, 0, 0, planes, 0, int(packed), 0, 0, 1, 1, w, h)
    body = b"ILBM" + chunk(b"BMHD", head) + chunk(b"CMAP", bytes(x for c in palette for x in c)) + chunk(b"CRNG", struct.pack(">hhhBB", 0, 5, 1, 2, 3)) + chunk(b"CAMG", struct.pack(">I", mode)) + chunk(b"BODY", b"".join(rows))
    return b"FORM" + struct.pack(">I", len(body)) + body


PALETTE = [(k * 8, 255 - k * 8, k) for k in range(32)]


def test_pictures(spark):
    v = np.arange(20 * 3).reshape(3, 20) % 32
    for packed in (False, True):
        w, h, rgb = iff.raster(ilbm(v, 5, PALETTE, packed=packed))
        assert (w, h) == (20, 3) and np.array_equal(np.frombuffer(rgb, np.uint8).reshape(3, 20, 3), np.array(PALETTE)[v])
    half = np.full((1, 16), 40)
    assert iff.raster(ilbm(half, 6, PALETTE, 0x80))[2][:3] == bytes(c >> 1 for c in PALETTE[8])
    ham = np.array([[3, 16 + 5, 32 + 7, 48 + 9] + [0] * 12])  # palette, blue, red, green
    out = np.frombuffer(iff.raster(ilbm(ham, 6, PALETTE, 0x800))[2], np.uint8).reshape(16, 3)
    assert out[:4].tolist() == [list(PALETTE[3]), [24, 231, 80], [112, 231, 80], [112, 144, 80]]
    assert iff.raster(ilbm(v, 5, PALETTE, 0x4))[0] == 40
    assert iff.describe(ilbm(v, 5, PALETTE)) == "20x3 32 colours" and iff.describe(ilbm(ham, 6, PALETTE, 0x800)) == "16x1 HAM6"
    files = spark.createDataFrame([("d", 1, ilbm(v, 5, PALETTE)), ("d", 2, b"no"), ("d", 3, None)], "disk_id string, sector int, content binary")
    assert [r.chunk for r in iff.chunks(files).orderBy("seq").collect()] == ["BMHD", "CMAP", "CRNG", "CAMG", "BODY"]
    broken = spark.createDataFrame([("d", 4, ilbm(v, 5, PALETTE)[:30]), ("d", 5, b"no")], files.schema)
    assert [(r.sector, r.width, r.problem is not None) for r in iff.pictures(broken).collect()] == [(4, None, True)]
    p = iff.pictures(files).first()
    assert (p.width, p.height, p.colours, p.ranges) == (20, 3, 32, [[5, 1, 2, 3]])
    assert len(iff.rasters(files).first().rgb) == 180
    assert iff.unpack_line(b"\x80\x00\x07", 0, 1) == (b"\x07", 3) and iff.unpack_line(b"\x80\x00\x07", 0, 1, compat=True) == (b"\0", 1)


def make_icon(extra=b""):
    image = struct.pack(">HHHHHIBBI", 0, 0, 8, 2, 2, 1, 3, 0, 0) + bytes([0b10000000, 0, 0b01000000, 0]) + bytes([0b10000000, 0, 0, 0])
    values = [0xE310, 1, 0, 1, 2, 8, 2, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1, 3, 0, 1, 1, 10, 20, 0, 0, 4096]
    text = lambda s: struct.pack(">I", len(s) + 1) + s + b"\0"
    return icon._HEAD.pack(*values) + image + image + text(b"SYS:Tool") + struct.pack(">I", 12) + text(b"A=1") + text(b"B") + extra


def test_icons(spark):
    body = b"ICON" + chunk(b"FACE", bytes([1, 0, 0, 0, 0, 5]))
    body += chunk(b"IMAG", struct.pack(">BBBBBBHH", 0, 1, 3, 0, 0, 1, 1, 5) + bytes([0, 1]) + bytes([1, 2, 3, 9, 8, 7]))
    bits = format(1, "08b") + "01"  # two elements of one bit, as they are
    body += chunk(b"IMAG", struct.pack(">BBBBBBHH", 0, 1, 0, 1, 0, 1, 2, 0) + int(bits.ljust(24, "0"), 2).to_bytes(3, "big") + b"\0")
    argb = bytes([255, 1, 2, 3, 128, 4, 5, 6])
    body += chunk(b"ARGB", bytes(10) + zlib.compress(argb)) + chunk(b"ARGB", bytes(10) + b"broken")
    data = make_icon(b"FORM" + struct.pack(">I", len(body)) + body)
    i = icon.parse(data)
    assert (i.default_tool, i.tool_types, len(i.images)) == ("SYS:Tool", ["A=1", "B"], 2) and i.images[0].tolist()[0][:2] == [3, 0] and i.images[0].tolist()[1][:2] == [0, 1]
    assert [s.rgba.tolist() for s in i.states] == [[[[1, 2, 3, 0], [9, 8, 7, 255]]], [[[1, 2, 3, 255], [9, 8, 7, 255]]], [[[1, 2, 3, 255], [4, 5, 6, 128]]]]
    plain = icon.image(icon.parse(make_icon()), 0)
    assert plain.rgba[0, 0].tolist() == [*icon.PALETTE_2[3], 255] and plain.rgba[0, 1, 3] == 0
    files = spark.createDataFrame([("d", 1, data), ("d", 2, make_icon()), ("d", 3, b"\xe3\x10")], "disk_id string, sector int, content binary")
    assert {r.sector: r.colour_states for r in icon.icons(files).collect()} == {1: 3, 2: 0, 3: None}  # the third cannot be read
    assert icon.rasters(files).where("problem IS NULL").count() == 5


def test_archives_in_tables(spark):
    from tests.test_archive import build, sample, track

    data = sample(1)
    good = build([track(0, data, 0, 0, data, len(data)), track(80, b"diz", 0, 0, b"diz", 3)])
    files = spark.createDataFrame([("a", good), ("b", b"none" * 20)], "archive_id string, content binary")
    assert {r.archive_id: r.status for r in archive.to_images(files).collect()} == {"a": "ok", "b": "not an archive"}
    assert [r.number for r in archive.archive_tracks(files).orderBy("number").collect()] == [0, 80]
    assert {r.archive_id: r.status for r in archive.archive_headers(files).collect()} == {"a": "ok", "b": "not an archive"}
    assert [(r.name, bytes(r.content)) for r in archive.extras(files).collect()] == [("FILEID.DIZ", b"diz")]


def test_unix_dates_of_years_beyond_9999(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # dates are shown in UTC
        got = spark.createDataFrame([(0,), (253_402_300_799,), (253_402_300_800,), (256_409 * 1_000_003,), (-1,)], "s bigint").select(f.unix_date_text(F.col("s"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r[0] for r in got] == ["1 Jan 1970 0:0:0", "31 Dec 9999 23:59:59", "1 Jan 10000 0:0:0", "20 Apr 10095 15:53:47", "31 Dec 1969 23:59:59"]
