"""One disk image in memory: walks along its pointers, and changes to it.

Used inside Arrow functions, one image at a time.  Walks keep what they have seen, so a cyclic or broken chain ends;
changes check space, names and ranges before they touch a byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SECTOR, SLOTS, BITS = 512, 72, 127 * 32
FILE, ROOT, FOLDER = 0xFFFFFFFD, 1, 2
NAME_LIMIT, COMMENT_LIMIT = 30, 79
READ_LIMIT = 40960  # sectors of one file after which content_compat reads no further extension block
_LONG = struct.Struct(">I")


class ImageError(ValueError):
    """The image, or what is asked of it, is not valid."""


@dataclass
class Entry:
    sector: int
    kind: str
    name: str
    size: int | None
    comment: str
    parent: int
    linked: int
    changed: tuple[int, int, int]
    bucket: int = -1
    depth: int = 0


def name_slot(name: str) -> int:
    upper = name.upper()
    h = len(upper)
    for c in upper:
        h = (h * 13 + ord(c)) & 0x7FF
    return h % SLOTS


def sector_checksum(data: bytes, at: int) -> int:
    words = np.frombuffer(data, ">u4").astype(np.int64)
    return int(-(words.sum() - words[at // 4])) & 0xFFFFFFFF


class Image:
    def __init__(self, content: bytes | bytearray | None):
        if not content or len(content) % (2 * SECTOR):
            raise ImageError("not a whole, even number of sectors")
        self.data = content
        self.count = len(content) // SECTOR
        self.root = self.count // 2
        if bytes(content[:3]) != b"DOS" or self.long(self.root, 0) != 2:
            raise ImageError("not a DOS volume")
        self.ffs = content[3] % 2 == 1
        self.payload = SECTOR if self.ffs else SECTOR - 24

    # reading
    def long(self, sector: int, offset: int) -> int:
        return _LONG.unpack_from(self.data, sector * SECTOR + offset)[0]

    def valid(self, sector: int) -> bool:
        return 0 < sector < self.count

    def pointers(self, sector: int, n: int = SLOTS, offset: int = 24) -> tuple[int, ...]:
        return struct.unpack_from(f">{n}I", self.data, sector * SECTOR + offset)

    def text(self, sector: int, offset: int) -> str:
        at = sector * SECTOR + offset
        return bytes(self.data[at + 1 : at + 1 + self.data[at]]).split(b"\0", 1)[0].decode("latin-1")

    def kind(self, sector: int) -> str:
        if not self.valid(sector):
            return "INVALID"
        return "FILE" if self.long(sector, SECTOR - 4) == FILE else "DIR"

    def entry(self, sector: int, bucket: int = -1, depth: int = 0) -> Entry:
        changed = struct.unpack_from(">3I", self.data, sector * SECTOR + SECTOR - 92)
        return Entry(sector, self.kind(sector), self.text(sector, SECTOR - 80), self.long(sector, SECTOR - 188), self.text(sector, SECTOR - 184), self.long(sector, SECTOR - 12), self.long(sector, SECTOR - 16), changed, bucket, depth)

    def entries(self, folder: int) -> list[Entry]:
        """Heads of the chains in slot order, then the second of each chain, and so on."""
        layer = [(s, slot) for slot, s in enumerate(self.pointers(folder)) if s]
        seen, out, depth = {folder}, [], 0
        while layer:
            after = []
            for s, slot in layer:
                if self.valid(s) and s not in seen:
                    seen.add(s)
                    e = self.entry(s, slot, depth)
                    out.append(e)
                    if e.linked:
                        after.append((e.linked, slot))
            layer, depth = after, depth + 1
        return out

    def walk(self) -> Iterator[tuple[str, Entry]]:
        """(path, entry) of everything below the root."""
        seen, todo = {self.root}, [(self.root, "")]
        while todo:
            folder, above = todo.pop(0)
            for e in self.entries(folder):
                path = f"{above}/{e.name}" if above else e.name
                yield path, e
                if e.kind == "DIR" and e.sector not in seen:
                    seen.add(e.sector)
                    todo.append((e.sector, path))

    def folders(self) -> list[int]:
        return [self.root, *dict.fromkeys(e.sector for _, e in self.walk() if e.kind == "DIR")]

    def extensions(self, sector: int, most: int | None = None) -> list[int]:
        out, seen = [], {sector}
        at = self.long(sector, SECTOR - 8)
        while self.valid(at) and at not in seen and (most is None or (len(out) + 1) * SLOTS < most):
            seen.add(at)
            out.append(at)
            at = self.long(at, SECTOR - 8)
        return out

    def data_sectors(self, sector: int, most: int | None = None) -> list[tuple[int, int]]:
        """(sector, bytes) of a file's data blocks in order, by the pointers (the last slot is the first block)."""
        left, out = self.long(sector, SECTOR - 188), []
        for s in (p for block in (sector, *self.extensions(sector, most)) for p in reversed(self.pointers(block))):
            if s and self.valid(s) and left > 0:
                n = min(left, self.payload)
                if not self.ffs:
                    n = min(n, self.long(s, 12)) if self.long(s, 0) == 8 else 0
                out.append((s, n))
                left -= n
        return out

    def chain(self, sector: int) -> list[tuple[int, int]]:
        """The same along the links of OFS data blocks."""
        out, seen, at = [], set(), self.long(sector, 16)
        while self.valid(at) and at not in seen and self.long(at, 0) == 8:
            seen.add(at)
            out.append((at, min(self.long(at, 12), SECTOR - 24)))
            at = self.long(at, 16)
        return out

    def content(self, sector: int, pointers: bool = True) -> bytes:
        """The file's bytes; what is missing is zero."""
        return self._joined(sector, self.data_sectors(sector) if pointers or self.ffs else self.chain(sector))

    def content_compat(self, sector: int, limit: int = READ_LIMIT) -> bytes:
        """As viewers read it: OFS along the links, FFS up to about 20 MB (``limit`` sectors) and zeros beyond."""
        return self._joined(sector, self.data_sectors(sector, limit) if self.ffs else self.chain(sector))

    def _joined(self, sector: int, found: list[tuple[int, int]]) -> bytes:
        size = min(self.long(sector, SECTOR - 188), len(self.data))
        head = 0 if self.ffs else 24
        return b"".join(bytes(self.data[s * SECTOR + head : s * SECTOR + head + n]) for s, n in found)[:size].ljust(size, b"\0")

    # space
    @property
    def bitmap_blocks(self) -> list[int]:
        out = list(self.pointers(self.root, 25, SECTOR - 196))
        while out and not out[-1]:
            out.pop()
        at, seen = self.long(self.root, SECTOR - 96), set()
        while self.valid(at) and at not in seen:
            seen.add(at)
            out += [p for p in self.pointers(at, 127, 0) if p]
            at = self.long(at, SECTOR - 4)
        return [p if self.valid(p) else 0 for p in out]

    def bits(self) -> np.ndarray:
        """Free flags; the first is sector 2.  A bitmap block that is missing has no free sector."""
        parts = []
        for p in self.bitmap_blocks:
            if p:
                longs = np.frombuffer(bytes(self.data[p * SECTOR + 4 : (p + 1) * SECTOR]), ">u4").astype("<u4")
                parts.append(np.unpackbits(longs.view(np.uint8), bitorder="little"))
            else:
                parts.append(np.zeros(BITS, np.uint8))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def free_size(self, strict: bool = False) -> tuple[int, int, int, int]:
        """Free blocks, total, free and used bytes."""
        free = int(self.bits()[: self.count - (2 if strict else 0)].sum())
        return free, len(self.data), free * SECTOR, len(self.data) - free * SECTOR

    def free_sectors(self) -> np.ndarray:
        return np.flatnonzero(self.bits()[: self.count - 2]) + 2

    def first_free(self) -> int | None:
        free = self.free_sectors()
        return int(free[0]) if len(free) else None

    # changing
    def _put(self, sector: int, offset: int, *values: int) -> None:
        struct.pack_into(f">{len(values)}I", self.data, sector * SECTOR + offset, *values)

    def _seal(self, sector: int, at: int = 20) -> None:
        self._put(sector, at, sector_checksum(bytes(self.data[sector * SECTOR : (sector + 1) * SECTOR]), at))

    def mark(self, sectors: list[int], free: bool) -> None:
        """Set or clear the bits of sectors and seal each bitmap block that changes once."""
        blocks, touched = self.bitmap_blocks, set()
        for s in sectors:
            block, bit = divmod(s - 2, BITS)
            if s < 2 or s >= self.count or block >= len(blocks) or not blocks[block]:
                continue
            at = 4 + bit // 32 * 4
            old = self.long(blocks[block], at)
            flag = 1 << bit % 32
            self._put(blocks[block], at, old | flag if free else old & ~flag)
            touched.add(blocks[block])
        for block in touched:
            self._seal(block, 0)

    def _name(self, sector: int, name: str) -> None:
        raw = name.encode("latin-1")
        at = sector * SECTOR + SECTOR - 80
        self.data[at : at + 32] = bytes([len(raw)]) + raw.ljust(31, b"\0")

    def check_name(self, name: str) -> None:
        try:
            raw = name.encode("latin-1")
        except UnicodeEncodeError:
            raise ImageError("name has characters outside Latin-1") from None
        if not 0 < len(raw) <= NAME_LIMIT or "/" in name or ":" in name:
            raise ImageError("names have 1 to 30 characters, without / and :")

    def find(self, folder: int, name: str) -> Entry | None:
        return next((e for e in self.entries(folder) if e.name.upper() == name.upper()), None)

    def resolve(self, path: str) -> int:
        """The sector of a path from the root; '' is the root."""
        at = self.root
        for part in filter(None, path.split("/")):
            e = self.find(at, part)
            if e is None:
                raise ImageError(f"no entry {part}")
            at = e.sector
        return at

    def _header(self, sector: int, kind: int, name: str, parent: int, size: int = 0, stamp: tuple[int, int, int] = (0, 0, 0)) -> None:
        self.data[sector * SECTOR : (sector + 1) * SECTOR] = bytes(SECTOR)
        self._put(sector, 0, 2, sector, 0, SLOTS if kind == FOLDER else 0)
        self._put(sector, SECTOR - 188, size)
        self._put(sector, SECTOR - 92, *stamp)
        self._put(sector, SECTOR - 12, parent)
        self._put(sector, SECTOR - 4, kind)
        self._name(sector, name)

    def _link(self, folder: int, sector: int, name: str) -> None:
        """Put an entry in front of its slot's chain."""
        at = 24 + 4 * name_slot(name)
        self._put(sector, SECTOR - 16, self.long(folder, at))
        self._seal(sector)
        self._put(folder, at, sector)
        self._seal(folder)

    def _unlink(self, sector: int) -> None:
        folder, after = self.long(sector, SECTOR - 12), self.long(sector, SECTOR - 16)
        if not self.valid(folder) and folder != self.root:
            raise ImageError("no parent")
        at = 24 + 4 * name_slot(self.text(sector, SECTOR - 80))
        if self.long(folder, at) == sector:
            self._put(folder, at, after)
            self._seal(folder)
            return
        for e in self.entries(folder):
            if e.linked == sector:
                self._put(e.sector, SECTOR - 16, after)
                self._seal(e.sector)
                return
        raise ImageError("entry is not linked in its folder")

    def _ready(self, folder: int, name: str, duplicates: bool) -> None:
        self.check_name(name)
        if folder != self.root and self.kind(folder) != "DIR":
            raise ImageError("not a folder")
        if not duplicates and self.find(folder, name):
            raise ImageError("name exists")

    def need(self, size: int) -> tuple[int, int]:
        """Data blocks and header blocks (the file header and its extensions)."""
        data = -(-size // self.payload)
        return data, max(1, -(-data // SLOTS))

    def write_file(self, name: str, content: bytes, folder: int | None = None, duplicates: bool = False, stamp: tuple[int, int, int] = (0, 0, 0)) -> int:
        """Header, extension blocks and data blocks take the lowest free sectors, in this order."""
        folder = folder or self.root
        self._ready(folder, name, duplicates)
        n_data, n_headers = self.need(len(content))
        free = self.free_sectors()
        if len(free) < n_data + n_headers:
            raise ImageError("not enough space")
        heads = free[:n_headers].tolist()
        blocks = free[n_headers : n_headers + n_data].tolist()
        self._header(heads[0], FILE, name, folder, len(content), stamp)
        self._put(heads[0], 8, n_data, 0, blocks[0] if blocks else 0)
        for k, s in enumerate(heads):
            if k:
                self.data[s * SECTOR : (s + 1) * SECTOR] = bytes(SECTOR)
                self._put(s, 0, 16, s, len(blocks[k * SLOTS : (k + 1) * SLOTS]))
                self._put(s, SECTOR - 12, heads[0])
                self._put(s, SECTOR - 4, FILE)
            mine = blocks[k * SLOTS : (k + 1) * SLOTS]
            self._put(s, 24, *reversed(mine + [0] * (SLOTS - len(mine))))
            self._put(s, SECTOR - 8, heads[k + 1] if k + 1 < n_headers else 0)
            self._seal(s)
        for k, s in enumerate(blocks):
            part = content[k * self.payload : (k + 1) * self.payload]
            self.data[s * SECTOR : (s + 1) * SECTOR] = bytes(SECTOR)
            if self.ffs:
                self.data[s * SECTOR : s * SECTOR + len(part)] = part
            else:
                self._put(s, 0, 8, heads[0], k + 1, len(part), blocks[k + 1] if k + 1 < n_data else 0, 0)
                self.data[s * SECTOR + 24 : s * SECTOR + 24 + len(part)] = part
                self._seal(s)
        self._link(folder, heads[0], name)
        self.mark(heads + blocks, False)
        return heads[0]

    def create_folder(self, name: str, folder: int | None = None, duplicates: bool = False, stamp: tuple[int, int, int] = (0, 0, 0)) -> int:
        folder = folder or self.root
        self._ready(folder, name, duplicates)
        sector = self.first_free()
        if sector is None:
            raise ImageError("not enough space")
        self._header(sector, FOLDER, name, folder, 0, stamp)
        self._link(folder, sector, name)
        self.mark([sector], False)
        return sector

    def delete(self, sector: int) -> None:
        """Unlink a file or an empty folder and free its blocks; the data stays on the disk."""
        kind = self.kind(sector)
        if kind == "INVALID" or sector == self.root or self.long(sector, 0) != 2:
            raise ImageError("no such entry")
        if kind == "DIR" and any(self.pointers(sector)):
            raise ImageError("folder is not empty")
        self._unlink(sector)
        heads = [sector, *self.extensions(sector)] if kind == "FILE" else [sector]
        blocks = [p for h in heads for p in self.pointers(h) if p] if kind == "FILE" else []
        self.mark(heads + blocks, True)

    def rename(self, sector: int, name: str, duplicates: bool = False) -> None:
        if self.kind(sector) == "INVALID" or sector == self.root or self.long(sector, 0) != 2:
            raise ImageError("no such entry")
        folder, old = self.long(sector, SECTOR - 12), self.text(sector, SECTOR - 80)
        if old.upper() == name.upper():
            self.check_name(name)
        else:
            self._ready(folder, name, duplicates)
        moved = name_slot(old) != name_slot(name)
        if moved:
            self._unlink(sector)
        self._name(sector, name)
        if moved:
            self._link(folder, sector, name)
        self._seal(sector)


def blank(sectors: int = 1760, label: str = "Empty", ffs: bool = False) -> bytearray:
    """A formatted image without entries."""
    if sectors < 8 or sectors % 2:
        raise ImageError("an even number of sectors, 8 at least")
    data = bytearray(sectors * SECTOR)
    data[:4] = b"DOS" + bytes([1 if ffs else 0])
    root = sectors // 2
    n = -(-(sectors - 2) // BITS)
    n_ext = max(0, -(-(n - 25) // 127))
    taken = list(range(root, root + 1 + n + n_ext))
    if taken[-1] >= sectors:
        raise ImageError("too small for its bitmap")
    maps, exts = taken[1 : 1 + n], taken[1 + n :]
    struct.pack_into(">4I", data, root * SECTOR, 2, 0, 0, SLOTS)
    struct.pack_into(f">{1 + min(n, 25)}I", data, root * SECTOR + SECTOR - 200, 0xFFFFFFFF, *maps[:25])
    if exts:
        struct.pack_into(">I", data, root * SECTOR + SECTOR - 96, exts[0])
    for k, e in enumerate(exts):
        mine = maps[25 + 127 * k : 25 + 127 * (k + 1)]
        struct.pack_into(f">{len(mine)}I", data, e * SECTOR, *mine)
        struct.pack_into(">I", data, e * SECTOR + SECTOR - 4, exts[k + 1] if k + 1 < len(exts) else 0)
    struct.pack_into(">I", data, root * SECTOR + SECTOR - 4, ROOT)
    image = Image(data)
    image._name(root, label)
    image._seal(root)
    flags = np.zeros(n * BITS, np.uint8)
    flags[: sectors - 2] = 1
    flags[np.array(taken) - 2] = 0
    for k, p in enumerate(maps):
        longs = np.packbits(flags[k * BITS : (k + 1) * BITS], bitorder="little").view("<u4").astype(">u4")
        data[p * SECTOR + 4 : (p + 1) * SECTOR] = longs.tobytes()
        image._seal(p, 0)
    return data
