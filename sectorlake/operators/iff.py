"""IFF containers and planar images."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.types import StructType


_BATCH = 1 << 20  # bytes, about; one file's rows may have more


def in_batches(files: Iterable[list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many files in batches of some size: a batch for each file costs more than what most files have."""
    held, size = [], 0
    for rows in files:
        held += rows
        size += sum(64 + sum(len(x) for x in r if isinstance(x, (bytes, bytearray, str, list))) for r in rows)
        if size >= _BATCH:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def map_files(files: DataFrame, rows: Callable[[bytes], list[tuple]], schema: str, key: tuple[str, ...] = ("disk_id", "sector")) -> DataFrame:
    """Rows that a function makes of each file's content, after the file's key columns.  A file that it cannot read has one row, with
    what is wrong as ``problem``."""
    keys = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in key)
    kind = StructType.fromDDL(f"{keys}, {schema}, problem string")
    none = [None] * (len(kind) - len(key) - 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for k in range(batch.num_rows):
                *own, data = (c[k].as_py() for c in batch.columns)
                try:
                    yield [(*own, *r, None) for r in rows(data or b"")]
                except (ValueError, IndexError, struct.error, KeyError) as e:
                    yield [(*own, *none, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return in_batches(found(batches), to_arrow_schema(kind))

    return files.select(*key, "content").mapInArrow(run, kind)


def walk(data: bytes, start: int = 12) -> Iterator[tuple[str, int, int]]:
    """(name, offset of the payload, size) of each chunk; odd sizes are padded by one byte."""
    at = start
    while at < len(data) - 7:
        size = struct.unpack_from(">I", data, at + 4)[0]
        yield data[at : at + 4].decode("latin-1"), at + 8, size
        at += 8 + size + size % 2


def chunks(files: DataFrame) -> DataFrame:
    """(disk_id, sector, seq, chunk, offset, size) of the chunks of IFF files."""

    def rows(data: bytes) -> list[tuple]:
        return [(k, *c) for k, c in enumerate(walk(data))] if data[:4] == b"FORM" else []

    return map_files(files, rows, "seq int, chunk string, offset int, size bigint")


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    x: int = 0
    y: int = 0
    planes: int = 0
    mask: int = 0
    compression: int = 0
    transparent: int = 0
    x_aspect: int = 0
    y_aspect: int = 0
    page_width: int = 0
    page_height: int = 0
    palette: list[tuple[int, int, int]] = field(default_factory=list)
    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)  # rate, flags, low, high
    interlaced: bool = False
    ehb: bool = False
    ham: bool = False
    hires: bool = False
    body: tuple[int, int] | None = None

    @property
    def colours(self) -> int | None:
        return 1 << self.planes if 1 <= self.planes <= 8 else None

    @property
    def colour_planes(self) -> int:
        return (4 if self.planes < 7 else 6) if self.ham else self.planes


def parse(data: bytes) -> Picture:
    """The headers of an ILBM file; the body stays where it is."""
    p = Picture()
    for name, at, size in walk(data):
        if name == "BMHD":
            p.width, p.height, p.x, p.y, p.planes, p.mask, p.compression, _, p.transparent, p.x_aspect, p.y_aspect, p.page_width, p.page_height = struct.unpack_from(">HHhhBBBBHBBHH", data, at)
        elif name == "CMAP":
            p.palette = [tuple(data[at + 3 * k : at + 3 * k + 3]) for k in range(min(size, len(data) - at) // 3)]
        elif name == "CRNG":
            _, rate, flags, low, high = struct.unpack_from(">hhhBB", data, at)
            p.ranges.append((rate, flags, low, high))
        elif name == "CAMG":
            mode = struct.unpack_from(">I", data, at)[0]
            p.interlaced, p.ehb, p.ham, p.hires = (bool(mode & m) for m in (0x4, 0x80, 0x800, 0x8000))
        elif name == "BODY":
            p.body = (at, size)
    if p.body:  # the order of palette and mode chunks is free, so both are settled here
        if p.ehb and p.palette:
            base = (p.palette + [(0, 0, 0)] * 32)[:32]
            p.palette = base + [(r >> 1, g >> 1, b >> 1) for r, g, b in base]
        p.hires |= p.width >= 640
        p.interlaced |= p.hires and p.height >= 400
    return p


def describe(data: bytes) -> str:
    p = parse(data)
    out = f"{p.width}x{p.height}" if p.width and p.height else ""
    if p.ham:
        return f"{out} HAM{6 if p.planes < 7 else 8}"
    return f"{out} {p.colours} colours" if p.colours else f"{out}palette with {len(p.palette)} colours"


@F.arrow_udf(T.StringType())
def inspect_udf(contents: pa.Array) -> pa.Array:
    def one(data: bytes | None) -> str | None:
        try:
            return describe(data) if data else None
        except (struct.error, ValueError):
            return None

    return pa.array([one(c.as_py()) for c in contents], pa.string())


def unpack_line(data: bytes, at: int, width: int, compat: bool = False) -> tuple[bytes, int]:
    """A line of ByteRun1: n < 128: n + 1 bytes as they are; n > 128: a byte 257 - n times; 128: nothing (compat: the line ends)."""
    out = bytearray()
    while len(out) < width and at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
        elif compat:
            break
    return bytes(out[:width].ljust(width, b"\0")), at


def pixels(data: bytes, p: Picture, compat: bool = False) -> np.ndarray:
    """(height, width) of plane values, hold-and-modify control bits included above the colour bits."""
    width = (p.width + 15) // 16 * 2
    at = p.body[0]
    planes = p.planes + (p.mask == 1)
    if p.compression:
        lines = []
        for _ in range(p.height * planes):
            line, at = unpack_line(data, at, width, compat)
            lines.append(line)
        raw = b"".join(lines)
    else:
        raw = data[at : at + p.height * planes * width].ljust(p.height * planes * width, b"\0")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(p.height, planes, width), axis=2)[:, : p.planes, : p.width]
    return (bits.astype(np.int32) << np.arange(p.planes)[None, :, None]).sum(1)


def raster(data: bytes, compat: bool = False) -> tuple[int, int, bytes]:
    """Width (doubled when interlaced but not hires), height and RGB bytes."""
    p = parse(data)
    if not p.body or not p.planes:
        raise ValueError("no picture")
    values = pixels(data, p, compat)
    table = np.zeros((max(256, len(p.palette)), 3), np.uint8)
    if p.palette:
        table[: len(p.palette)] = p.palette
    if p.ham:
        index, control = values & ((1 << p.colour_planes) - 1), values >> p.colour_planes
        level = (index << (8 - p.colour_planes)).astype(np.uint8)
        out = np.zeros((p.height, p.width, 3), np.uint8)
        before = np.zeros((p.height, 3), np.uint8)
        for x in range(p.width):  # a pixel may take over what stands at its left; all lines go on together
            c = control[:, x]
            colour = np.where((c == 0)[:, None], table[index[:, x]], before)
            for code, channel in ((1, 2), (2, 0), (3, 1)):
                colour[:, channel] = np.where(c == code, level[:, x], colour[:, channel])
            out[:, x] = before = colour
    else:
        out = table[values]
    if p.interlaced and not p.hires:
        out = out.repeat(2, axis=1)
    return out.shape[1], out.shape[0], out.tobytes()


def pictures(files: DataFrame) -> DataFrame:
    """(disk_id, sector, width, height, planes, colours, ...) of ILBM files, without their pixels."""

    def rows(data: bytes) -> list[tuple]:
        if data[:4] != b"FORM" or data[8:12] != b"ILBM":
            return []
        p = parse(data)
        return [(p.width, p.height, p.x, p.y, p.planes, p.mask, p.compression, p.transparent, p.x_aspect, p.y_aspect, p.page_width, p.page_height, p.colours, [list(c) for c in p.palette], [list(r) for r in p.ranges], p.interlaced, p.ehb, p.ham, p.hires)]

    schema = "width int, height int, x int, y int, planes int, mask int, compression int, transparent int, x_aspect int, y_aspect int, page_width int, page_height int, colours int, palette array<array<int>>, ranges array<array<int>>, interlaced boolean, ehb boolean, ham boolean, hires boolean"
    return map_files(files, rows, schema)


def rasters(files: DataFrame, compat: bool = False) -> DataFrame:
    """(disk_id, sector, width, height, rgb): 3 bytes a pixel, line by line."""
    return map_files(files, lambda d: [raster(d, compat)] if d[:4] == b"FORM" and d[8:12] == b"ILBM" else [], "width int, height int, rgb binary")
