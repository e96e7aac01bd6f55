import random

import pytest
from hypothesis import given, settings, strategies as st

from sectorlake.functions.image import Image, ImageError, blank, name_slot
from tests import walker


@pytest.mark.parametrize("ffs", [False, True])
@pytest.mark.parametrize("size", [0, 1, 487, 488, 489, 511, 512, 513, 488 * 72, 488 * 73 + 5, 512 * 145 + 1])
def test_write_and_read(ffs, size):
    data = random.Random(size).randbytes(size)
    im = Image(blank(ffs=ffs))
    before = im.free_size(True)[0]
    folder = im.create_folder("sub")
    sector = im.write_file("a file", data, folder)
    assert im.content(sector) == data
    if not ffs:
        assert im.content(sector, pointers=False) == data
    files, used = walker.read(bytes(im.data))
    assert files == {"sub/": None, "sub/a file": data}
    assert not used & walker.free(bytes(im.data))
    assert before - im.free_size(True)[0] == len(used) == sum(im.need(size)) + 1
    assert walker.sums_ok(bytes(im.data), [im.root, *im.bitmap_blocks, sector, folder, *im.extensions(sector)])
    im.delete(sector)
    im.delete(folder)
    assert im.free_size(True)[0] == before and walker.read(bytes(im.data))[0] == {}


@pytest.mark.parametrize("ffs", [False, True])
def test_files_over_twenty_megabytes_are_whole(ffs):
    data = random.Random(1).randbytes(21_100_000)
    im = Image(blank(sectors=45_000, ffs=ffs))
    before = im.free_size(True)[0]
    sector = im.write_file("large", data)
    assert im.content(sector) == data
    assert (im.content_compat(sector) == data) != ffs and len(im.content_compat(sector)) == len(data)
    im.delete(sector)
    assert im.free_size(True)[0] == before


def colliding(n):
    found, k = [], 0
    while len(found) < n:
        if name_slot(f"f{k}") == 5:
            found.append(f"f{k}")
        k += 1
    return found


def test_hash_chains():
    im, names = Image(blank()), colliding(4)
    sectors = [im.write_file(n, n.encode()) for n in names]
    assert [e.name for e in im.entries(im.root)] == names[::-1]
    assert [e.depth for e in im.entries(im.root)] == [0, 1, 2, 3]
    im.rename(sectors[1], "other name")  # from the middle of the chain
    assert {e.name for e in im.entries(im.root)} == {names[0], names[2], names[3], "other name"}
    im.delete(sectors[2])
    assert {e.name for e in im.entries(im.root)} == {names[0], names[3], "other name"}
    im.rename(sectors[0], names[0].upper())
    assert im.find(im.root, names[0]).name == names[0].upper()


def test_refusals():
    im = Image(blank(sectors=16))
    im.write_file("x", b"1")
    before = bytes(im.data)
    for call in (lambda: im.write_file("x", b""), lambda: im.write_file("X", b""), lambda: im.write_file("a/b", b""), lambda: im.write_file("n" * 31, b""), lambda: im.write_file("big", bytes(20000)), lambda: im.delete(im.root), lambda: im.delete(9999), lambda: im.rename(3, "a:b"), lambda: im.write_file("€", b"")):
        with pytest.raises(ImageError):
            call()
        assert bytes(im.data) == before
    while im.first_free():
        im.create_folder(f"d{im.first_free()}")
    with pytest.raises(ImageError):
        im.create_folder("full")
    with pytest.raises(ImageError):
        im.write_file("empty", b"")
    im = Image(blank())
    folder = im.create_folder("d")
    im.write_file("f", b"1", folder)
    with pytest.raises(ImageError):
        im.delete(folder)
    im.write_file("f", b"2", folder, duplicates=True)
    assert len(im.entries(folder)) == 2


def test_cycles_and_bad_pointers_end():
    im = Image(blank())
    a, b = (im.write_file(n, bytes(1000)) for n in colliding(2))
    im._put(a, 496, b)  # a chain that bites its tail
    assert {e.sector for e in im.entries(im.root)} == {a, b}
    first = im.chain(a)[0][0]
    im._put(first, 16, first)
    assert len(im.chain(a)) == 1 and im.content(a, pointers=False) == bytes(1000)
    im._put(a, 504, a)
    assert im.extensions(a) == []
    im._put(im.root, 24, 0xFFFFFF)
    im._put(a, 496, 0x7FFFFFFF)
    assert a in {e.sector for e in im.entries(im.root)} or b in {e.sector for e in im.entries(im.root)}
    d = im.create_folder("loop")
    im._put(d, 24, d)
    assert list(im.walk())


@pytest.mark.parametrize("sectors, blocks, ext", [(1760, 1, 0), (8192, 3, 0), (4064 * 26 + 100, 27, 1)])
def test_bitmaps_of_larger_disks(sectors, blocks, ext):
    im = Image(blank(sectors))
    assert len(im.bitmap_blocks) == blocks
    assert set(im.free_sectors().tolist()) == walker.free(bytes(im.data)) == set(range(2, sectors)) - set(range(im.root, im.root + 1 + blocks + ext))
    last = int(im.free_sectors()[-1])
    im.mark([last], False)
    assert last not in walker.free(bytes(im.data)) and walker.sums_ok(bytes(im.data), im.bitmap_blocks)


names = st.text(st.characters(min_codepoint=33, max_codepoint=255, exclude_characters="/:"), min_size=1, max_size=30)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["write", "mkdir", "delete", "rename"]), names, st.binary(max_size=3000)), max_size=12), st.booleans())
def test_any_order_of_changes_stays_sound(steps, ffs):
    im, model = Image(blank(ffs=ffs)), {}
    start = im.free_size(True)[0]
    for op, n, data in steps:
        here = next(iter(model), None)
        try:
            if op == "write":
                im.write_file(n, data)
                model[n] = data
            elif op == "mkdir":
                im.create_folder(n)
                model[n + "/"] = None
            elif here and op == "delete":
                im.delete(im.find(im.root, here.rstrip("/")).sector)
                del model[here]
            elif here:
                im.rename(im.find(im.root, here.rstrip("/")).sector, n)
                model[n + "/" * here.endswith("/")] = model.pop(here)
        except ImageError:
            pass
    files, used = walker.read(bytes(im.data))
    assert files == model
    assert start - im.free_size(True)[0] == len(used)
