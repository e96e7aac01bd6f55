"""Workbench icon files: planar images, tool types, colour states and true-colour images."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from sectorlake.operators.iff import map_files, walk

#: The colours of icons without a palette of their own, for revision 0 and later ones.
PALETTE_1 = [(85, 170, 255), (255, 255, 255), (0, 0, 0), (255, 136, 0)]
PALETTE_2 = [(149, 149, 149), (0, 0, 0), (255, 255, 255), (59, 103, 162), (123, 123, 123), (175, 175, 175), (170, 144, 124), (255, 169, 151)]
_HEAD = struct.Struct(">HHIHHHHHHHIIIIIHIBBIIIIIII")
_NAMES = "magic version next_gadget left_edge top_edge width height flags activation gadget_type gadget_render select_render gadget_text mutual_exclude special_info gadget_id user_data type padding default_tool tool_types current_x current_y drawer_data tool_window stack_size".split()


@dataclass
class State:
    width: int
    height: int
    rgba: np.ndarray  # (height, width, 4), alpha 0 to 255


@dataclass
class Icon:
    head: dict[str, int]
    images: list[np.ndarray | None] = field(default_factory=list)  # palette indices
    sizes: list[tuple[int, int, int]] = field(default_factory=list)
    default_tool: str | None = None
    tool_types: list[str] = field(default_factory=list)
    tool_window: str | None = None
    drawer: tuple[int, int] | None = None  # flags, view modes
    states: list[State] = field(default_factory=list)


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, fmt: str) -> tuple:
        out = struct.unpack_from(fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return out

    def text(self) -> str:
        """A long with the size, the closing zero included."""
        (n,) = self.take(">I")
        raw = self.data[self.at : self.at + max(0, n - 1)]
        self.at += n
        return raw.split(b"\0", 1)[0].decode("latin-1")

    def image(self) -> tuple[tuple[int, int, int], np.ndarray | None]:
        _, _, width, height, depth, has, _, _, _ = self.take(">HHHHHIBBI")
        if not has:
            return (width, height, depth), None
        line = (width + 15) // 16 * 2
        n = line * height * depth
        raw = self.data[self.at : self.at + n].ljust(n, b"\0")
        self.at += n
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(depth, height, line), axis=2)[:, :, :width]
        return (width, height, depth), (bits.astype(np.int32) << np.arange(depth)[:, None, None]).sum(0)


def parse(data: bytes) -> Icon:
    if len(data) < _HEAD.size or data[:2] != b"\xe3\x10":
        raise ValueError("not an icon")
    icon = Icon(dict(zip(_NAMES, _HEAD.unpack_from(data), strict=True)))
    h = icon.head
    r = _Reader(data, _HEAD.size + (56 if h["drawer_data"] else 0))
    for wanted in (True, h["select_render"]):
        if wanted:
            size, image = r.image()
            icon.sizes.append(size)
            icon.images.append(image)
    if h["default_tool"]:
        icon.default_tool = r.text()
    if h["tool_types"]:
        (n,) = r.take(">I")
        icon.tool_types = [r.text() for _ in range(max(0, n // 4 - 1))]
    if h["tool_window"]:
        icon.tool_window = r.text()
    if h["drawer_data"] and h["user_data"]:
        icon.drawer = r.take(">IH")
    rest = data[r.at :]
    if rest[:4] == b"FORM" and rest[8:12] == b"ICON":
        icon.states = colour_states(rest)
    return icon


def colour_states(form: bytes, palette_bits: int | None = 8) -> list[State]:
    """The states of a FORM ICON.  palette_bits: the size of elements in a packed palette (None: as deep as the image)."""
    width = height = 0
    out: list[State] = []
    palette = np.zeros((0, 3), np.uint8)
    for name, at, size in walk(form):
        if name == "FACE":
            width, height = form[at] + 1, form[at + 1] + 1
        elif name == "IMAG":
            transparent, _, flags, packed, packed_palette, depth, n_image, n_palette = struct.unpack_from(">BBBBBBHH", form, at)
            body = form[at + 10 : at + size]
            values = unpack_bits(body[: n_image + 1], depth, width * height) if packed else np.frombuffer(body[: n_image + 1], np.uint8)
            if flags & 2 or not len(palette):  # else the palette of the state before
                raw = body[n_image + 1 : n_image + 1 + n_palette + 1]
                flat = unpack_bits(raw, palette_bits or depth, 768) if packed_palette else np.frombuffer(raw, np.uint8)
                if len(flat) > 2:
                    palette = flat[: len(flat) // 3 * 3].reshape(-1, 3).astype(np.uint8)
            index = np.zeros(width * height, np.int64)
            index[: min(len(values), len(index))] = values[: len(index)]
            table = np.zeros((256, 4), np.uint8)
            table[: len(palette), :3], table[: len(palette), 3] = palette, 255
            if flags & 1:
                table[transparent, 3] = 0
            out.append(State(width, height, table[index].reshape(height, width, 4)))
        elif name == "ARGB":
            try:
                raw = zlib.decompress(form[at + 10 : at + size])
            except zlib.error:
                continue
            argb = np.frombuffer(raw[: width * height * 4].ljust(width * height * 4, b"\0"), np.uint8).reshape(height, width, 4)
            out.append(State(width, height, np.ascontiguousarray(argb[:, :, [1, 2, 3, 0]])))
    return out


def unpack_bits(data: bytes, depth: int, most: int) -> np.ndarray:
    """Run lengths of 8 bits with elements of ``depth`` bits, not aligned to bytes."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    weight = 1 << np.arange(depth - 1, -1, -1)
    out: list[int] = []
    at, end = 0, max(0, len(data) - 1) * 8
    element = lambda i: int(bits[i : i + depth] @ weight) if i + depth <= len(bits) else 0
    while at < end and len(out) < most:
        n = int(np.packbits(bits[at : at + 8])[0])
        at += 8
        if n > 128:
            out += [element(at)] * (257 - n)
            at += depth
        elif n < 128:
            out += [element(at + k * depth) for k in range(n + 1)]
            at += (n + 1) * depth
    return np.array(out[:most], np.int64)


def image(icon: Icon, index: int = 0) -> State | None:
    """What is shown for a state: the colour state if there is one, else the planar image in the fixed colours; index 0 is clear."""
    if icon.states:
        return icon.states[index] if index < len(icon.states) else None
    if index >= len(icon.images) or icon.images[index] is None:
        return None
    fixed = PALETTE_2 if icon.head["user_data"] else PALETTE_1
    table = np.zeros((256, 4), np.uint8)
    table[: len(fixed), :3], table[: len(fixed), 3], table[0, 3] = fixed, 255, 0
    shown = table[np.minimum(icon.images[index], 255)]
    return State(shown.shape[1], shown.shape[0], shown)


def icons(files: DataFrame) -> DataFrame:
    """(disk_id, sector, ...) of icon files."""

    def rows(data: bytes) -> list[tuple]:
        i = parse(data)
        h = i.head
        return [(h["version"], h["width"], h["height"], h["type"], h["user_data"], h["current_x"], h["current_y"], h["stack_size"], i.default_tool, i.tool_types, i.tool_window, [list(s) for s in i.sizes], len(i.states))]

    return map_files(files, rows, "version int, width int, height int, type int, user_data bigint, current_x bigint, current_y bigint, stack_size bigint, default_tool string, tool_types array<string>, tool_window string, images array<array<int>>, colour_states int")


def rasters(files: DataFrame) -> DataFrame:
    """(disk_id, sector, state, width, height, rgba) of each image of icon files."""

    def rows(data: bytes) -> list[tuple]:
        i = parse(data)
        found = [(k, image(i, k)) for k in range(len(i.states) or len(i.images))]
        return [(k, s.width, s.height, s.rgba.tobytes()) for k, s in found if s]

    return map_files(files, rows, "state int, width int, height int, rgba binary")
