import random
import struct
import sys

import pytest

from sectorlake.operators import archive as a


class Out:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def bytes(self):
        bits = self.bits + "0" * (-len(self.bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big") + bytes(2)


def escape(data):
    """Runs, and the escape byte as itself."""
    out, i = bytearray(), 0
    while i < len(data):
        j = i
        while j < len(data) and data[j] == data[i] and j - i < 60000:
            j += 1
        n = j - i
        if n > 254:
            out += bytes([0x90, 0xFF, data[i]]) + struct.pack(">H", n)
        elif n > 3:
            out += bytes([0x90, n, data[i]])
        else:
            out += b"".join(b"\x90\x00" if x == 0x90 else bytes([x]) for x in data[i:j])
        i = j
    return bytes(out)


def matches(data, window, longest, shortest):
    """Greedy literals (x, None) and copies (distance, length), within one track."""
    i = 0
    while i < len(data):
        best = (0, 0)
        for d in range(1, min(i, window) + 1):
            n = 0
            while n < longest and i + n < len(data) and data[i + n] == data[i + n - d]:
                n += 1
            if n > best[1]:
                best = (d, n)
        if best[1] >= shortest:
            yield best
            i += best[1]
        else:
            yield data[i], None
            i += 1


def position(out, distance):
    """A distance by the code of its upper bits, then the rest."""
    d = distance - 1
    upper, low = d >> 8, d & 0xFF
    first = a._UPPER.index(upper)
    n = a._EXTRA[first]
    first |= low >> n  # the free lower bits of the first byte carry the top of the low byte
    out.put(first, 8)
    out.put(low & ((1 << n) - 1), n)


def quick(data):
    out = Out()
    for x, n in matches(data, 200, 5, 2):
        if n is None:
            out.put(1, 1), out.put(x, 8)
        else:
            out.put(0, 1), out.put(n - 2, 2), out.put(x - 1, 8)
    return out.bytes()


def medium(data):
    out = Out()
    for x, n in matches(data, 1000, 60, 3):
        if n is None:
            out.put(1, 1), out.put(x, 8)
            continue
        out.put(0, 1)
        d = x - 1
        first = a._UPPER.index(n - 3)
        e1 = a._EXTRA[first]
        # the second byte of the code is made of the free bits of the first and e1 more
        for low in range(1 << (8 - e1)):
            for more in range(1 << e1):
                second = ((first + low) << e1 | more) & 0xFF if a._UPPER[min(first + low, 255)] == n - 3 else None
                if second is None or a._UPPER[second] != d >> 8:
                    continue
                e2 = a._EXTRA[second]
                for rest in range(1 << e2):
                    if (second << e2 | rest) & 0xFF == d & 0xFF:
                        out.put(first + low, 8), out.put(more, e1), out.put(rest, e2)
                        break
                else:
                    continue
                break
            else:
                continue
            break
        else:
            raise AssertionError("no code")
    return out.bytes()


def deep(data, tree):
    out = Out()
    for x, n in matches(data, 1000, 60, 3):
        symbol = x if n is None else n + 253
        for b in tree.path(symbol):
            out.put(b, 1)
        tree.update(symbol)
        if n is not None:
            position(out, x)
    return out.bytes()


def heavy(data, last_code):
    out = Out()
    out.put(510, 9)
    for _ in range(510):
        out.put(9, 5)
    out.put(last_code + 1, 5)
    for _ in range(last_code + 1):
        out.put(4, 4)
    before = None
    for x, n in matches(data, 1000, 250, 3):
        out.put(x if n is None else n + 253, 9)
        if n is None:
            continue
        d = x - 1
        if d == before:
            out.put(last_code, 4)
        else:
            k = d.bit_length()
            out.put(k, 4)
            if k:
                out.put(d & ((1 << (k - 1)) - 1), k - 1)
            before = d
    return out.bytes()


def track(number, data, mode, flags, packed, middle):
    head = struct.pack(">2sHHHHHBBHH", b"TR", number, 0, len(packed), middle, len(data), flags, mode, a.additive(data), a.crc16(packed))
    return head + struct.pack(">H", a.crc16(head)) + packed


def build(parts, general=0, kind=0):
    head = bytearray(56)
    head[:4] = b"DMS!"
    struct.pack_into(">HIHH", head, 10, general, 1_000_000_000, 0, 79)
    struct.pack_into(">HHH", head, 46, 111, 0, kind)
    head[50:52] = struct.pack(">H", kind)
    struct.pack_into(">H", head, 54, a.crc16(bytes(head[4:54])))
    return bytes(head) + b"".join(parts)


def sample(seed, n=2500):
    r = random.Random(seed)
    words = [r.randbytes(r.randint(2, 9)) for _ in range(30)] + [b"\x90", bytes(300), b"\x90\x90\x90\x90\x90"]
    return b"".join(r.choice(words) for _ in range(n))[:n]


def packed(mode, data, tree):
    e = escape(data)
    return {0: lambda: (data, len(data)), 1: lambda: (e, len(data)), 2: lambda: (quick(e), len(e)), 3: lambda: (medium(e), len(e)), 4: lambda: (deep(e, tree), len(e)), 5: lambda: (heavy(e, 13), len(e)), 6: lambda: (heavy(e, 14), len(e))}[mode]()


@pytest.mark.parametrize("mode", range(7))
def test_modes(mode):
    parts, want = [], {}
    for number in range(3):
        data = sample(mode * 10 + number)
        body, middle = packed(mode, data, a.Adaptive())
        parts.append(track(number, data, mode, 2 | 4 if mode > 4 else 0, body, middle))
        want[number] = data
    disk, extras, status = a.unpack(build(parts))
    assert status == "ok" and not extras and len(disk) == 80 * 11264
    for k, data in want.items():
        assert disk[k * 11264 : k * 11264 + len(data)] == data


def test_deep_state_carries_over_and_the_tree_is_halved():
    tree, parts, want = a.Adaptive(), [], b""
    for number in range(14):
        data = random.Random(number).randbytes(2600)
        parts.append(track(number, data, 4, 1, deep(escape(data), tree), len(escape(data))))
        want += data.ljust(11264, b"\0")
    disk, _, status = a.unpack(build(parts))
    assert status == "ok" and disk[: len(want)] == want


def test_checks_and_extras():
    data = sample(1)
    good, banner, diz = track(0, data, 0, 0, data, len(data)), track(0xFFFF, b"hello", 0, 0, b"hello", 5), track(80, b"diz", 0, 0, b"diz", 3)
    disk, extras, status = a.unpack(build([banner, good, diz]))
    assert (status, extras) == ("ok", [("banner", b"hello"), ("FILEID.DIZ", b"diz")]) and disk[: len(data)] == data
    bad = bytearray(good)
    bad[100] ^= 1
    assert [t.status for t in a.tracks(build([bytes(bad)]))] == ["track data checksum"]
    bad = bytearray(good)
    bad[3] ^= 1
    assert [t.status for t in a.tracks(build([bytes(bad)]))] == ["track header checksum"]
    assert a.unpack(build([good], kind=7))[2] == "FMS archive" and a.unpack(b"nope" * 20)[2] == "not an archive" and a.unpack(b"")[2] == "too short"
    assert [t.status for t in a.tracks(build([track(0, data, 9, 0, data, 0)]))] == ["unknown mode"]
    assert len(a.unpack(build([good], general=16))[0]) == 160 * 11264


def test_encryption():
    data, key = sample(3, 2100), a.crc16(b"secret")
    plain, crypt, k = escape(data), bytearray(), key
    for x in plain:
        c = x ^ k & 0xFF
        crypt.append(c)
        k = (k >> 1) + c & 0xFFFF
    archive = build([track(0, data, 1, 0, bytes(crypt), len(data))], general=2)
    disk, _, status = a.unpack(archive, "secret")
    assert status == "ok" and disk[: len(data)] == data
    assert a.unpack(archive, "wrong")[2] == "wrong password"


def test_keys_of_stored_tracks_are_found():
    data, key = sample(4, 2100), 0x1234
    crypt, k = bytearray(), key
    for x in data:
        c = x ^ k & 0xFF
        crypt.append(c)
        k = (k >> 1) + c & 0xFFFF
    found = a._search(0, 0, bytes(crypt), len(data), len(data), a.additive(data))
    assert a.additive(a.decrypt(bytes(crypt), found)[0]) == a.additive(data)
    disk, _, status = a.unpack(build([track(0, data, 0, 0, bytes(crypt), len(data))], general=2))
    assert status == "ok" and len(disk) == 80 * 11264


def test_statuses():
    data = sample(5)
    good = track(0, data, 0, 0, data, len(data))
    assert a.unpack(b"\x1f\x8b" + bytes(60))[2] == "packed with gzip"
    assert a.unpack(build([b"XX" + bytes(40)]))[2] == "no track header"
    assert a.unpack(build([good[:-5]]))[2] == "track is cut off"
    assert a.unpack(build([track(0, bytes(33000), 0, 0, bytes(33000), 33000)]))[2] == "track too large"
    assert a.unpack(build([good, b"trailing bytes, of any kind and length"]))[2] == "ok"


def test_packed_disks_come_back():
    r = random.Random(6)
    for n in (0, 1, 11264, 30000):
        disk = b"".join(r.choice([b"\x90", b"ab", bytes(300), b"\x90" * 5, b"x" * 70000]) for _ in range(n // 300 + 1))[:n]
        for mode in range(7):
            got, extras, status = a.unpack(a.pack(disk, mode))
            assert a.unpack(a.pack(disk, mode, "word"), "word")[0] == got
            assert status == "ok" and not extras and got == disk.ljust(80 * 11264, b"\0")
    with pytest.raises(ValueError):
        a.pack(bytes(80 * 11264 + 1))


def test_known_crc():
    assert a.crc16(b"123456789") == 0xBB3D


def calls(work):
    """How many functions a call runs through."""
    count = 0

    def seen(frame, event, arg):
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        out = work()
    finally:
        sys.setprofile(None)
    return out, count


def words(n):
    r = random.Random(9)
    return b" ".join(r.choice([b"the", b"disk", b"holds", b"many", b"words", b"and", b"\x90"]) for _ in range(n // 3))[:n]


@pytest.mark.parametrize("mode", range(7))
def test_unpacking_takes_few_steps_a_byte(mode):
    text = words(60000)
    packed_ = a.pack(text, mode)
    (disk, _, status), count = calls(lambda: a.unpack(packed_))
    assert status == "ok" and disk[: len(text)] == text and count < (5 if mode == 4 else 0.5) * len(text)


@pytest.mark.parametrize("mode", range(7))
def test_packing_takes_few_steps_a_byte(mode):
    text = words(60000).replace(b"\x90", b"box")
    packed_, count = calls(lambda: a.pack(text, mode))
    assert a.unpack(packed_)[0][: len(text)] == text and count < (12 if mode == 4 else 0.5) * len(text)


def test_sums_and_keys_against_one_byte_at_a_time():
    r = random.Random(11)
    for n in (0, 1, 63, 64, 255, 256, 257, 3000):
        for data in (r.randbytes(n), bytes(n), b"\xff" * n):
            crc, key, plain, start = 0, r.randrange(1 << 16), bytearray(), 0
            start = key
            for x in data:
                crc = crc >> 8 ^ a._CRC[(crc ^ x) & 0xFF]
                plain.append(x ^ key & 0xFF)
                key = (key >> 1) + x & 0xFFFF
            assert a.crc16(data) == crc and a.decrypt(data, start) == (bytes(plain), key) and a.encrypt(bytes(plain), start) == (data, key)


def test_tracks_of_disk_images(spark):
    disk = bytes(11264) + b"x" * 11264 + bytes(11264) + b"y"
    files = spark.createDataFrame([("a", bytearray(a.pack(disk, 2))), ("empty", bytearray(a.pack(bytes(11264)))), ("bad", bytearray(b"nope" * 20))], "archive_id string, content binary")
    got = {(r.archive_id, r.number): (r.status, r.size, r.data and bytes(r.data)) for r in a.image_tracks(files).collect()}
    whole = 80 * 11264
    assert got == {("a", 1): ("ok", whole, b"x" * 11264), ("a", 3): ("ok", whole, b"y".ljust(11264, b"\0")), ("empty", None): ("ok", whole, None), ("bad", None): ("not an archive", None, None)}
    assert {r.archive_id: r.status for r in a.image_status(files).collect()} == {"a": "ok", "empty": "ok", "bad": "not an archive"}


def test_archive_queries_make_each_wanted_archive_once(spark):
    from sectorlake.plans import contract, volumes  # noqa: F401

    for name, maps in (("archive_encrypted", 4), ("archive_images", 2)):
        plan = contract.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == maps and "Join" not in plan
    assert plan.count("octet_length(content") < 3  # images are not cut by columns
    encrypted = contract.QUERIES["archive_encrypted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "3-0" in encrypted[encrypted.rindex("MapInArrow") :]  # the filter stands below the packing


def test_adaptive_bits_take_one_walk_a_byte():
    r = random.Random(12)
    data = bytes(min(255, int(r.expovariate(0.05))) for _ in range(70000))  # the code is halved on the way
    tree, want = a.Adaptive(), []
    for x in data:
        want += tree.path(x)
        tree.update(x)
    fast = a.Adaptive()
    (first, rest), count = calls(lambda: (fast.encode(data[:40000]), fast.encode(data[40000:])))
    assert first.tolist() + rest.tolist() == want and (fast.weight, fast.below, fast.above) == (tree.weight, tree.below, tree.above)
    assert count < 3 * len(data) and not len(fast.encode(b""))


def test_packed_runs_against_one_byte_at_a_time():
    r = random.Random(13)
    for n in (*range(9), 253, 254, 255, 256, 0xFFFF, 0x10000, 0x10003, 0x10004):
        for x in (b"a", b"\x90"):
            for data in (x * n, b"ab" + x * n, x * n + b"\x90", b"\x90\x90" + x * n + b"cccc"):
                assert a.runs(a.packed_runs(data), len(data)) == data
                if n < 0xFFFF:
                    assert a.packed_runs(data) == escape(data)
    for _ in range(300):
        data = b"".join(r.choice([b"\x90", b"a", b"ab", b"x" * r.randint(1, 6), b"\x90" * r.randint(1, 6), bytes(300)]) for _ in range(r.randint(0, 30)))
        assert a.packed_runs(data) == escape(data)


def test_rows_of_many_files_go_in_few_batches():
    import pyarrow as pa

    from sectorlake.operators import iff

    schema = pa.schema([("id", pa.int32()), ("content", pa.binary())])
    files = [[(k, bytes(1000))] if k % 3 else [] for k in range(3000)] + [[(-1, bytes(3 << 20)), (-2, None)], [(-3, b"")]]
    found = list(iff.in_batches(files, schema))
    assert [r for b in found for r in b["id"].to_pylist()] == [r[0] for f in files for r in f]
    assert len(found) < 6 and max(b.nbytes for b in found[:-2]) < 2 << 20 and not list(iff.in_batches([[], []], schema))


def test_headers_are_read_of_their_bytes_and_parts_grow_with_the_input(spark, monkeypatch):
    from sectorlake.plans import contract, volumes

    query = lambda: contract.QUERIES["archive_headers"](spark, "/root/testdata/sf0.001")
    plan = query()._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(content#" in plan[: plan.rindex("MapInArrow")] and f", 1, {a.HEAD})" in plan
    few = query().rdd.getNumPartitions()
    monkeypatch.setattr(volumes, "_TASK", 1000)
    assert few == 16 and query().rdd.getNumPartitions() > 100
    good = a.pack(b"disk" * 9000, 4)
    files = spark.createDataFrame([("a", bytearray(good)), ("head", bytearray(good[: a.HEAD])), ("short", bytearray(good[: a.HEAD - 1])), ("none", None)], "archive_id string, content binary")
    assert {r.archive_id: (r.status, r.unpacked) for r in a.archive_headers(files).collect()} == {"a": ("ok", 4 * 11264), "head": ("ok", 4 * 11264), "short": ("too short", None), "none": ("too short", None)}


def same_sums(n):
    """Texts of which a wrong key makes others with the same sum."""
    r, found = random.Random(14), []
    while len(found) < n:
        text = bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz", k=70))
        other, _ = a.decrypt(a.encrypt(text, a.crc16(b"secret"))[0], a.crc16(b"guess"))
        if other != text and other[50:] == text[50:] and a.additive(other) == a.additive(text):
            found.append(text)
    return found


def test_wrong_passwords_are_known_where_sums_stay_the_same():
    for text in same_sums(2):
        for disk in (text, text + b"more" * 9000):
            whole = a.pack(disk, 0, "secret")
            assert a.unpack(whole, "secret") == (disk.ljust(80 * 11264, b"\0"), [], "ok") and a.status(whole, "secret") == a.status(a.pack(disk)) == "ok"
            for archive in (whole, whole + b"trailing bytes"):
                assert a.unpack(archive, "guess")[2] == a.status(archive, "guess") == "wrong password" == next(a.tracks(archive, "guess")).status
            assert a.unpack(whole[:-1], "secret")[0] == a.unpack(whole, "secret")[0]  # archives without a note are read as before
    assert len({a.key_note(k) for k in range(1 << 16)}) == 1 << 16


def test_the_first_status_is_that_of_unpacking():
    data = sample(5)
    good, bad = track(0, data, 0, 0, data, len(data)), bytearray(track(1, data, 9, 0, data, len(data)))
    bad[50] ^= 1
    locked = [a.pack(words(30000), mode, "secret") for mode in range(7)]
    damaged = [x[:k] + bytes([x[k] ^ 1]) + x[k + 1 :] for x in locked for k in (3, 20, 60, 70, 100, len(x) - 100)]
    for x in (b"", b"\x1f\x8b" + bytes(60), build([]), build([good]), build([good, bytes(bad)]), build([good[:-5]]), build([good], kind=7), *locked, *(x[:-5000] for x in locked), *damaged):
        for password in ("secret", "guess"):
            assert a.status(x, password) == a.unpack(x, password)[2]


def test_encrypted_archives_of_zeros_and_of_the_same_sums(spark, tmp_path):
    import duckdb

    from sectorlake.plans import contract, volumes  # noqa: F401

    texts = [(3, "\0" * 12000 + "text"), (13, "text" + "\0" * 40000), (23, "\0" * 30000)]
    texts += [(70 * k + d, t.decode()) for k, t in enumerate(same_sums(2)) for d in (63, 43)]  # stored, and with runs
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    contract.QUERIES["archive_encrypted"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine, theirs = f"SELECT archive_id, flags, status, size, number, md5, otherwise FROM '{tmp_path}/out/*.parquet'", contract.SQL["archive_encrypted"]
    assert con.execute(f"SELECT count(*) FROM (({mine} EXCEPT ALL {theirs}) UNION ALL ({theirs} EXCEPT ALL {mine}))").fetchall() == [(0,)]
    assert con.execute(f"SELECT count(*) FROM ({mine})").fetchall() == [(2 + 4 + 3 + 4,)]


def test_every_archive_is_encrypted_and_read_with_both_passwords(spark, tmp_path):
    import duckdb

    from sectorlake.plans import contract, volumes

    texts = [(k, f"text {k} " * (20 * k)) for k in range(60)] + [(64, None), (65, ""), (66, "a disk of more than 80 tracks " * 31000)]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    contract.QUERIES["archive_encrypted"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine, theirs = f"SELECT archive_id, flags, status, size, number, md5, otherwise FROM '{tmp_path}/out/*.parquet'", contract.SQL["archive_encrypted"]
    assert con.execute(f"SELECT count(*) FROM (({mine} EXCEPT ALL {theirs}) UNION ALL ({theirs} EXCEPT ALL {mine}))").fetchall() == [(0,)]
    found = {x for (x,) in con.execute(f"SELECT DISTINCT archive_id FROM ({mine})").fetchall()}
    assert found == {f"{k}-0" for k, t in texts if t} | {"66-1"} and 30 * 31000 > volumes._DISK


def test_encrypting_many_is_encrypting_each():
    r = random.Random(16)
    for n in (0, 1, 47, 48, 130):
        strings = [r.randbytes(r.choice([0, 1, 5, 1023, 1024, 1025, 3000])) for _ in range(n)]
        for key in (0, 0xFFFF, 0x23D2):
            assert a.encrypt_all(strings, key) == [a.encrypt(x, key)[0] for x in strings]
    disks = [(sample(k, r.choice([0, 1, 500, 11264, 20000])), k % 7) for k in range(70)]
    for password in (None, "word"):
        assert a.pack_all(disks, password) == [a.pack(disk, mode, password) for disk, mode in disks]
    (_, count) = calls(lambda: a.encrypt_all([bytes(4000)] * 300, 1))
    assert count < 0.1 * 300 * 4000
