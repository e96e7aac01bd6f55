"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its five-word shingles: a shingle weighs as often as it occurs.  For each element, darts arrive along a
rank axis as a Poisson process whose draws are hashes of the element, the weight cell and the number of the dart; a dart also hits
a point of the weight axis and one of ``K`` coordinates.  The earliest dart inside the element's weight, of each coordinate, is the
signature: two sets agree in a coordinate with the probability of their weighted Jaccard similarity (the sum of the lesser weights by
the sum of the greater ones), and about K ln K darts are thrown however large the set.

Equal word sequences are one class before anything is joined.  Signatures are cut into bands; in a bucket of one band
value the least class is the centre and is compared with the others exactly (a star, so pairs grow with rows).  What no
link joins in a bucket then is compared by signatures alone, in tiles of bounded size (``near``); only what agrees there in
``AGREE`` coordinates or more with another part of its bucket is compared exactly, in blocks: each pair of tiles is one group of work
that returns no more links than it has rows.  So texts of a hot bucket that are merely alike are not copied from task to task.
A pair at the threshold is missed with probability 0.00007 by banding and 0.000001 by the signatures.

Defined cases: a null text is an empty text; texts without words are copies of each other; texts of one to four words
have one shingle, of all their words; a very long text is one row, its darts bounded; ties fall in one class; repeated rows of one
doc_id and text are one document and get equal results; a null doc_id is in no class (class_id null, kept true); an empty table
gives an empty result; columns other than those named are ignored, or passed on by ``survivors``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sectorlake.llm.components import components, least_reached
from sectorlake.llm.session import Stored, columns, cut
from sectorlake.llm.textcore import U64, Spans, chunks, mix, row_bounds, shingles, word_spans

THRESHOLD = (4, 5)  # a similarity of 4/5, compared in whole numbers
WORDS = 5
BANDS, ROWS = 24, 5
K = BANDS * ROWS
DARTS = int(K * (np.log(K) + 3))  # expected; a set with an empty coordinate throws twice as many
TILE = 192  # classes in a tile of texts
SIGNED_TILE = 2048  # classes in a tile of signatures
AGREE = 74  # of K coordinates; at the threshold 96 are expected, with a standard deviation of 4.4
_C = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(n, K) signatures of n sets.  elements: hashes, distinct within a set; owner: the set of each; weights: positive.

    A set without elements gets zeros."""
    out = np.full((n, K), np.iinfo(np.uint64).max, U64)
    total = np.bincount(owner, weights, n)
    todo, darts = np.flatnonzero(total > 0), float(DARTS)
    while len(todo):
        inside = np.isin(owner, todo) if len(todo) < n else np.ones(len(owner), bool)
        limit = np.zeros(n)
        limit[todo] = darts / total[todo]
        _throw(out, elements[inside], owner[inside], None if weights is None else weights[inside], limit)
        todo, darts = todo[(out[todo] == np.iinfo(np.uint64).max).any(1)], darts * 2
    out[total == 0] = 0
    return out


def _throw(out: np.ndarray, elements: np.ndarray, owner: np.ndarray, weights: np.ndarray | None, limit: np.ndarray) -> None:
    """Keep, for each set and coordinate, the earliest dart up to the set's rank limit."""
    flat = out.reshape(-1)
    top = 0 if weights is None else int(np.log2(weights.max() + 1))
    for cell in range(top + 1):  # the weights from 2**cell - 1 to 2**(cell + 1) - 1
        low, width = 2.0**cell - 1, 2.0**cell
        at = np.arange(len(elements)) if weights is None else np.flatnonzero(weights > low)
        e, o, rank = mix(elements[at] + U64(cell * int(_C[1]) & 0xFFFFFFFFFFFFFFFF)), owner[at], np.zeros(len(at))
        w = None if weights is None else weights[at]
        bound, dart = limit[o], 0
        while len(e):
            n = min(256, max(1, (1 << 16) // len(e)))  # darts of each element at a time: many where few elements are left
            h = mix(e[:, None] + np.arange(dart, dart + n, dtype=U64) * _C[0])
            step = np.log(((h >> U64(11)) + U64(1)).astype(np.float64) * 2.0**-53) / -width
            step[:, 0] += rank
            arrival = np.cumsum(step, 1)
            live = arrival <= bound[:, None]
            hits = live.sum(1)
            g, when, set_ = mix(h[live] ^ _C[2]), arrival[live], np.repeat(o, hits)
            if w is not None:
                inside = low + width * (mix(g ^ _C[1]) >> U64(11)).astype(np.float64) * 2.0**-53 <= np.repeat(w, hits)
                g, when, set_ = g[inside], when[inside], set_[inside]
            packed = when.astype(np.float32).view(np.uint32).astype(U64) << U64(32) | (g & U64(0xFFFFFFFF))
            np.minimum.at(flat, set_ * K + ((g >> U64(32)) % U64(K)).astype(np.int64), packed)
            more = live[:, -1]
            e, o, rank, bound, w = e[more], o[more], arrival[more, -1], bound[more], None if w is None else w[more]
            dart += n


def bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands, different from band to band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * _C[0], parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mix((h ^ parts[:, :, r]) * _C[1] + U64(r))
    return h.view(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingle hashes of the texts of a chunk, the row (sorted) and weight of each, and a digest of each row's words."""
    starts, ends, rows = word_spans(data, offsets)
    words = Spans(data).hash(starts, ends)
    n = len(offsets) - 1
    at = row_bounds(rows, n)
    digest = word_digests(data, starts, ends, at)
    every = shingles(words, WORDS) if len(words) >= WORDS else np.empty(0, U64)
    own = np.flatnonzero(rows[WORDS - 1 :] == rows[: len(rows) - WORDS + 1]) if len(words) >= WORDS else np.empty(0, np.int64)
    found, owner = every[own], rows[own]
    short = np.flatnonzero((np.diff(at) < WORDS) & (np.diff(at) > 0))
    if len(short):
        found = np.concatenate([found, *(shingles(words[at[i] : at[i + 1]], WORDS) for i in short)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))[: len(found)]
    begin = np.flatnonzero(first)
    return found[begin], owner[begin], np.diff(np.append(begin, len(found))), digest


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A 128-bit digest of the words of each row, one space between them; at: where each row's words are."""
    size = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate([data, [0x20]]).astype(np.uint8)[np.minimum(np.repeat(starts - total[:-1], size) + np.arange(total[-1]), len(data))]
    flat[total[1:] - 1] = 0x20
    view = memoryview(flat)
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(total[at[:-1]].tolist(), total[at[1:]].tolist(), strict=True)]


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, hi, lo, bands, sketch) of every row with an id; hi and lo: the digest of the words; sketch: 16 bits of each
    coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                found, owner, weight, digest = shingle_sets(data, offsets)
                s = signatures(found, owner, hi - lo, weight if len(weight) and weight.max() > 1 else None)
                b = bands(s)
                full = np.bincount(owner, minlength=hi - lo) > 0
                sketch = pa.array([x.tobytes() for x in s.astype("<u2")], pa.binary())
                halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                size = np.where(full, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(b[full].ravel()))
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists, sketch], names=["id", "text_hash", "hi", "lo", "bands", "sketch"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id bigint, text_hash bigint, hi bigint, lo bigint, bands array<bigint>, sketch binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def similar(pairs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """pairs: (a, b, text_a, text_b).  Those whose sets have at least the threshold's similarity, as (a, b)."""
    part, whole = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_set = None, None
        for batch in batches:
            a = batch.column(0).to_numpy()
            good = np.zeros(len(a), bool)
            sets = _sets(batch.column(3))
            for i, other in enumerate(sets):
                if a[i] != centre:
                    centre, centre_set = a[i], next(_sets(batch.column(2).slice(i, 1)))
                if not (len(other) * whole < len(centre_set) * part or len(centre_set) * whole < len(other) * part):
                    common = len(np.intersect1d(centre_set, other, assume_unique=True))
                    good[i] = common * whole >= part * (len(other) + len(centre_set) - common)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in chunks(column):
        found, owner, weight, _ = shingle_sets(data, offsets)
        if len(weight) and weight.max() > 1:  # an element for each occurrence: their plain similarity is the weighted one
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            owner, every = np.repeat(owner, weight), np.repeat(found, weight)
            found = np.where(nth > 0, mix(every ^ mix(nth.astype(U64) * _C[0])), every)
        at = row_bounds(owner, hi - lo)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield found[a:b]


def tile_links(sets: list[np.ndarray], part: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs, of different parts, of sets with at least the threshold's similarity."""
    n, size = len(sets), np.array([len(s) for s in sets])
    names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)  # whole numbers below 2 ** 24 a block
    total = np.zeros((n, n), np.int64)
    width = max(64, (1 << 20) // n)
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        block = np.zeros((n, width), np.float32)
        block[row[lo:hi], column[lo:hi] - k * width] = 1
        np.matmul(block, block.T, out=common)
        total += common.astype(np.int64)
    good = total * threshold[1] >= threshold[0] * (size[:, None] + size[None, :] - total)
    return np.nonzero(np.triu(good & (part[:, None] != part[None, :]), 1))


def _dealt(left: DataFrame, tile: int) -> DataFrame:
    """left: (bucket, key, part).  Each row for each pair of tiles of its bucket that it is in: (bucket, lo, hi, key, part); buckets with
    the same members once."""
    named = left.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s"))
    once = cut(named.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    own = left.join(once, "bucket").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("bucket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "key", "part")


def near(left: DataFrame, sketches: DataFrame, tile: int = SIGNED_TILE, agree: int = AGREE) -> DataFrame:
    """left: (bucket, key, part); sketches: (key, sketch).  The rows of left whose signatures agree with those of another part."""
    group = ["bucket", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, parts, now = [], [], [], None

        def settle() -> Iterator[pa.RecordBatch]:
            if len(set(parts)) > 1:
                sketch, part = np.frombuffer(b"".join(held), "<u2").reshape(len(held), K), np.array(parts)
                found = np.zeros(len(held), bool)
                for a in range(0, len(held), 256):
                    equal = np.zeros((len(sketch[a : a + 256]), len(held)), np.uint8)
                    for k in range(K):
                        equal += sketch[a : a + 256, k, None] == sketch[None, :, k]
                    found[a : a + 256] = ((equal >= agree) & (part[a : a + 256, None] != part)).any(1)
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(some), pa.int64()), pa.array(np.array(keys)[some]), pa.array(part[some])], names=["bucket", "key", "part"])

        for batch in batches:
            names = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            for name, key, part, sketch in zip(names, *(c.to_pylist() for c in batch.columns[3:]), strict=True):
                if name != now:
                    yield from settle()
                    held, keys, parts, now = [], [], [], name
                held.append(sketch)
                keys.append(key)
                parts.append(part)
        yield from settle()

    rows = _dealt(left, tile).join(sketches, "key").select(*group, "key", "part", "sketch").repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(run, "bucket bigint, key bigint, part bigint").distinct()


def blocks(left: DataFrame, texts: DataFrame, threshold: tuple[int, int] = THRESHOLD, tile: int = TILE) -> DataFrame:
    """left: (bucket, key, part), buckets that hold several parts; texts: (key, text).  Links (a, b) that join what the links
    between different parts of a bucket join."""
    group = ["bucket", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, parts, now = [], [], [], None

        def settle() -> Iterator[pa.RecordBatch]:
            if len(set(parts)) > 1:
                i, j = tile_links(held, np.array(parts), threshold)
                label = least_reached(len(held), i, j)
                key = np.array(keys)
                to = np.flatnonzero(label != np.arange(len(held)))
                yield pa.RecordBatch.from_arrays([pa.array(key[to]), pa.array(key[label[to]])], names=["a", "b"])

        for batch in batches:
            names = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            for name, key, part, own_set in zip(names, batch.column(3).to_pylist(), batch.column(4).to_pylist(), _sets(batch.column(5)), strict=True):
                if name != now:
                    yield from settle()
                    held, keys, parts, now = [], [], [], name
                held.append(own_set.copy())
                keys.append(key)
                parts.append(part)
        yield from settle()

    return _dealt(left, tile).join(texts, "key").select(*group, "key", "part", "text").repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a bigint, b bigint")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(id, text_hash, class_id, kept) of every row with an id."""
    rows = cut(signed(docs, id_col, text_col))
    same = rows.groupBy("hi", "lo").agg(F.min(F.struct("id", "text_hash")).alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(same.select(F.monotonically_increasing_id().alias("key"), "hi", "lo", "least", "bands", "sketch"))
    spread = classes.select("key", F.explode("bands").alias("bucket"))
    # tables of buckets are cut before they are joined: a join of two plain tables can be split where one bucket is hot
    shared = cut(spread.groupBy("bucket").agg(F.min("key").alias("centre"), F.max("key").alias("last")).where("centre < last").select("bucket", "centre"))
    members = cut(spread.join(shared, "bucket").where("key != centre").select("bucket", "centre", "key"))
    wanted = members.select("key").union(members.select(F.col("centre").alias("key"))).distinct()
    wanted = wanted.join(classes.select("key", "least.*"), "key")
    texts = Stored(_rows(docs, id_col, text_col).join(wanted, ["id", "text_hash"]).groupBy("key").agg(F.min("text").alias("text")))

    pairs = members.select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    one = pairs.join(texts.df.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.df.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    links = cut(similar(both, threshold))
    joined = components(links)

    left = cut(members.join(joined.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("part")))
    apart = cut(left.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("bucket"))
    asked = cut(near(left.join(apart, "bucket"), classes.select("key", "sketch"), agree=AGREE if threshold == THRESHOLD else 0))
    more = cut(blocks(asked, texts.df, threshold))
    texts.drop()
    joined = components(links.unionByName(more))

    part = classes.join(joined.withColumnRenamed("node", "key"), "key", "left").select("hi", "lo", "least", F.coalesce("component", "key").alias("part"))
    first = cut(part.groupBy("part").agg(F.min("least").alias("first")))
    named = cut(part.join(first, "part").select("hi", "lo", "first"))
    out = rows.select("id", "text_hash", "hi", "lo").join(named, ["hi", "lo"])
    kept = (F.col("id") == F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return out.select("id", "text_hash", F.col("first.id").alias("class_id"), kept.alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, class_id (the least id of the row's group of near-duplicates), kept (the group's first)."""
    found = classify(docs, id_col, text_col)
    without = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("class_id"), F.lit(True).alias("kept"))
    return found.select("id", "class_id", "kept").unionByName(without).withColumnRenamed("id", id_col)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group; repeated rows of one id and text count once."""
    found = classify(docs, id_col, text_col)
    first = found.where("kept").groupBy("id", "text_hash").agg(F.count("*").alias("times"))
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    tagged = docs.select(F.struct(*columns(docs)).alias("row"), F.col(id_col).cast("bigint").alias("id"), text.alias("text_hash"))
    stay = tagged.join(first, ["id", "text_hash"])
    once, more = stay.where("times = 1"), stay.where("times > 1").dropDuplicates(["id", "text_hash"])
    null = tagged.where("id IS NULL").select("row")
    return once.select("row").unionByName(more.select("row")).unionByName(null).select("row.*")
