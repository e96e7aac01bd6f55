"""An independent, plain reader of images for the tests: follows the layout with its own arithmetic."""

import struct


def u32(d, sector, off):
    return struct.unpack(">I", d[sector * 512 + off : sector * 512 + off + 4])[0]


def name(d, s):
    n = d[s * 512 + 432]
    return d[s * 512 + 433 : s * 512 + 433 + n].decode("latin-1")


def read(d):
    """path -> content of every file, by pointers; and the set of sectors in use by entries."""
    ffs, root, files, used = d[3] % 2 == 1, len(d) // 1024, {}, set()

    def folder(s, above):
        for slot in range(72):
            at = u32(d, s, 24 + 4 * slot)
            while at:
                used.add(at)
                path = f"{above}/{name(d, at)}".lstrip("/")
                if u32(d, at, 508) == 0xFFFFFFFD:
                    size, out, block = u32(d, at, 324), b"", at
                    while block:
                        used.add(block)
                        for k in range(71, -1, -1):
                            p = u32(d, block, 24 + 4 * k)
                            if p:
                                used.add(p)
                                out += d[p * 512 : p * 512 + 512] if ffs else d[p * 512 + 24 : p * 512 + 24 + u32(d, p, 12)]
                        block = u32(d, block, 504)
                    files[path] = out[:size]
                else:
                    files[path + "/"] = None
                    folder(at, path)
                at = u32(d, at, 496)

    folder(root, "")
    return files, used


def free(d):
    """Sectors whose bit is set."""
    root, count, out = len(d) // 1024, len(d) // 512, set()
    maps = [u32(d, root, 316 + 4 * k) for k in range(25)]
    ext = u32(d, root, 416)
    while ext:
        maps += [u32(d, ext, 4 * k) for k in range(127)]
        ext = u32(d, ext, 508)
    for k, m in enumerate(x for x in maps if x):
        for w in range(127):
            v = u32(d, m, 4 + 4 * w)
            out |= {2 + k * 4064 + w * 32 + b for b in range(32) if v >> b & 1}
    return {s for s in out if s < count}


def sums_ok(d, sectors, at=20):
    return all(sum(struct.unpack(">128I", d[s * 512 : s * 512 + 512])) % 2**32 == 0 for s in sectors)
