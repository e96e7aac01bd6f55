"""Line dedup by pairwise alignment.

A line that at most ``RARE`` documents hold, of ``RARE_WORDS`` words or more, is rare: two documents that share it overlap.  Each
document is linked to the first (by doc_id) that holds each of its rare lines, so links grow with lines.  More frequent lines are
no evidence alone; a run of consecutive lines of ``MIN_WORDS`` words or more is, however many documents hold it, and links each
of them to its first holder in the same way (the shortest runs that start and that end at each line).

Each linked pair is aligned with patience diff; what it leaves of the later document is searched for passages that stand in the
first in another order (``moved``).  A common block, a run of lines that both hold unbroken, goes from the later document if it
holds a rare line of the pair or has ``MIN_WORDS`` words.  Lines without words are passed over; lines are compared without the
white space at their ends.

A passage of ``MIN_WORDS`` words or more may start or end inside a line.  A line of fewer words goes too if an earlier document
holds it, whole, in the same window of ``MIN_WORDS`` words (``windows``; line breaks around it do not count).  The windows are
looked at only for lines that are held with half of the missing words before or after them (``edges``), which every such line is.

Links and edges are candidates, found by 64-bit hashes; equality in an alignment is by 96 bits of two hashes, in windows by 128.

A pair's work is its two line sequences; a first document that very many share is one row of a join that can be split.

Defined cases: a null text stays null; a row with a null doc_id is passed on unchanged; rows that repeat a doc_id and
text are one document and are treated alike; documents that share a doc_id are ordered by the hash of their text; a very long
text is one row, its work linear in its lines for each link; an empty table gives an empty result; other columns are passed on,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sectorlake.llm.session import Stored, columns, cut
from sectorlake.llm.textcore import Spans, chunks, line_spans, mix, row_bounds, run_hashes, word_spans

MIN_WORDS = 50
RARE, RARE_WORDS = 20, 5  # documents that hold a rare line at most, and its words at least
_CHECK = 0x5DEECE66D  # the key of second hashes


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Blocks (start in a, start in b, length) of the patience diff of two sequences."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0, 1))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1, 1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        once = [(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at]
        anchors = _increasing(once)
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += [(i, j, 1) for i, j in anchors]
        if anchors:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False) if i + 1 < k and j + 1 < m]
    blocks: list[tuple[int, int, int]] = []
    for i, j, _ in sorted(out):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs, ordered by i, in which j grows too."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(top_at[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            top_at.append(k)
        else:
            tops[at], top_at[at] = j, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def moved(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """(start, length) of every part of b that stands in a unbroken and can be extended at neither end, by the suffix automaton of a."""
    after, link, size, last = [{}], [-1], [0], 0
    for x in a:
        new = len(size)
        after.append({})
        size.append(size[last] + 1)
        link.append(0)
        at, last = last, new
        while at >= 0 and x not in after[at]:
            after[at][x] = new
            at = link[at]
        if at < 0:
            continue
        other = after[at][x]
        if size[other] == size[at] + 1:
            link[new] = other
            continue
        copy = len(size)
        after.append(dict(after[other]))
        size.append(size[at] + 1)
        link.append(link[other])
        link[other] = link[new] = copy
        while at >= 0 and after[at].get(x) == other:
            after[at][x] = copy
            at = link[at]
    at = n = 0
    for j, x in enumerate(b):
        before = n
        while at and x not in after[at]:
            at = link[at]
            n = size[at]
        at = after[at].get(x, 0)
        n = n + 1 if at else 0
        if before and n <= before:
            yield j - before, before
    if n:
        yield len(b) - n, n


def aligned(a: list[int], b: list[int], words: np.ndarray, rare: set[int], least: int = MIN_WORDS) -> tuple[np.ndarray, int]:
    """Whether each line of b stands in a common block with a rare line or ``least`` words (words: of each line of b), and how many
    of those lines patience diff found."""
    total = np.concatenate([[0], np.cumsum(words)]).tolist()
    evident = np.concatenate([[0], np.cumsum([x in rare for x in b])]).tolist()
    step = [0] * (len(b) + 1)

    def mark(found) -> np.ndarray:
        for j, n in found:
            if total[j + n] - total[j] >= least or evident[j + n] > evident[j]:
                step[j] += 1
                step[j + n] -= 1
        return np.cumsum(step[:-1]) > 0

    gone = mark((j, n) for _, j, n in patience(a, b))
    by_patience, known = int(gone.sum()), set(a)
    if any(x in known for x, g in zip(b, gone.tolist(), strict=True) if not g):
        gone = mark(moved(a, b))
    return gone, by_patience


def sequences(docs: DataFrame, id_col: str, text_col: str, least: int, rare_words: int) -> DataFrame:
    """(id, text_hash, lines, checks, numbers, words, names): per document two hashes, number and words of each line with a word,
    and its different names: odd ones of lines of ``rare_words`` words, even ones of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                n, all_ = hi - lo, _Lines(data, offsets)
                row, name = all_.names(n, least, rare_words)
                lists = [(all_.row, x) for x in (all_.name.view(np.int64), all_.check, all_.number.astype(np.int32), (all_.end - all_.first).astype(np.int32))]
                lists = [pa.ListArray.from_arrays(pa.array(row_bounds(r, n).astype(np.int32)), pa.array(x)) for r, x in [*lists, (row, name.view(np.int64))]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), *lists], names=["id", "text_hash", "lines", "checks", "numbers", "words", "names"])

    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "id bigint, text_hash bigint, lines array<bigint>, checks array<int>, numbers array<int>, words array<int>, names array<bigint>")


class _Lines:
    """The lines with words of a chunk of texts: row, number in the text, first and end word, name; and where each row's words are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begin, end, rows = line_spans(data, offsets)
        number = np.arange(len(rows)) - row_bounds(rows, len(offsets) - 1)[rows]
        starts, ends, word_rows = word_spans(data, offsets)
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        full = last > first
        self.row, self.number, self.first, self.end = rows[full], number[full], first[full], last[full]
        spans = Spans(data)
        self.name = spans.hash(starts[self.first], ends[self.end - 1])
        self.check = spans.hash(starts[self.first], ends[self.end - 1], _CHECK).astype(np.uint32).view(np.int32)
        self.word = spans.hash(starts, ends)
        at = row_bounds(word_rows, len(offsets) - 1)
        self.low, self.high = at[:-1][self.row], at[1:][self.row]

    def names(self, n: int, least: int, rare_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, name), different and by row: of lines of ``rare_words`` words, and of the shortest runs of ``least`` words from and
        to each line."""
        size = self.end - self.first
        total = np.concatenate([[0], np.cumsum(size)])
        at = row_bounds(self.row, n)
        line = np.arange(len(size))
        end = np.searchsorted(total, total[:-1] + least)
        from_ = np.flatnonzero(end <= at[1:][self.row])
        start = np.searchsorted(total, total[1:] - least, "right") - 1
        to = np.flatnonzero(start >= at[:-1][self.row])
        first, last = np.unique(np.stack([np.concatenate([line[from_], start[to]]), np.concatenate([end[from_], line[to] + 1])]), axis=1)
        long_ = np.flatnonzero(size >= rare_words)
        row = np.concatenate([self.row[long_], self.row[first]])
        name = np.concatenate([mix(self.name[long_]) | np.uint64(1), run_hashes(self.name, first, last) & ~np.uint64(1)])
        key = np.unique(np.stack([row.astype(np.uint64), name]), axis=1) if len(row) else np.empty((2, 0), np.uint64)
        return key[0].astype(np.int64), key[1]

    def edges(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash): each line under ``least`` words with half of the missing words before it, and with as many after it."""
        size = self.end - self.first
        half = (least - size + 1) // 2
        some = (size < least) & (self.high - self.low >= least)
        left, right = np.flatnonzero(some & (self.first - half >= self.low)), np.flatnonzero(some & (self.end + half <= self.high))
        before = mix(self.name[left] ^ run_hashes(self.word, self.first[left] - half[left], self.first[left]))
        after = mix(~self.name[right] ^ run_hashes(self.word, self.end[right], self.end[right] + half[right]))
        return np.concatenate([left, right]), np.concatenate([before, after])

    def windows(self, wanted: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, hash, second hash): each wanted line with each window of ``least`` words around it, by its place in the window."""
        low = np.maximum(self.low[wanted], self.end[wanted] - least)
        high = np.minimum(self.high[wanted] - least, self.first[wanted])
        n = np.maximum(0, high - low + 1)
        line = np.repeat(wanted, n)
        start = np.repeat(low, n) + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        place = (self.first[line] - start).astype(np.uint64)
        hashes = [run_hashes(w, start, start + least) ^ mix(self.name[line] + place) for w in (self.word, mix(self.word ^ np.uint64(_CHECK)))]
        return line, mix(hashes[0]), mix(~hashes[1])


_DOC = "struct<id: bigint, text_hash: bigint>"


def _inside(docs: DataFrame, id_col: str, text_col: str, least: int, gone: DataFrame) -> DataFrame:
    """(doc, number, first): lines under ``least`` words, not among the ``gone`` (doc, number), that stand whole in a window of
    ``least`` words of an earlier document."""
    text = F.col(text_col).cast("string")
    named = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.struct(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash")).alias("doc"), text.alias("text"))

    def out(batch: pa.RecordBatch, lo: int, lines: _Lines, line: np.ndarray, *hashes: np.ndarray) -> pa.RecordBatch:
        cols = [batch.column(0).take(pa.array(lo + lines.row[line])), pa.array(lines.number[line].astype(np.int32)), *(pa.array(h.view(np.int64)) for h in hashes)]
        return pa.RecordBatch.from_arrays(cols, names=["doc", "number", "name", "name2"][: len(cols)])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column(1)):
                lines = _Lines(data, offsets)
                yield out(batch, lo, lines, *lines.edges(least))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), 1 << 18):
                lines = _Lines(data, offsets)
                asked = [np.array(x, np.int64) for x in batch.column(2).slice(lo, hi - lo).to_pylist()]
                at = row_bounds(lines.row, hi - lo)
                wanted = np.concatenate([a + np.searchsorted(lines.number[a:b], x) for a, b, x in zip(at[:-1], at[1:], asked, strict=True)])
                yield out(batch, lo, lines, *lines.windows(wanted, least))

    kind = f"doc {_DOC}, number int, name bigint"
    held = Stored(named.mapInArrow(edges, kind))
    firsts = lambda df, *by: df.groupBy(*by).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select(*by, "first")
    shared = cut(held.df.join(firsts(held.df, "name"), "name"))
    open_ = shared.where("first < doc").join(gone, ["doc", "number"], "left_anti").select("name").distinct()
    asked = shared.join(open_, "name", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    texts = named.join(asked, "doc").dropDuplicates(["doc"]).select("doc", "text", "numbers")
    near = Stored(texts.mapInArrow(windows, kind + ", name2 bigint"))
    found = cut(near.df.join(firsts(near.df, "name", "name2"), ["name", "name2"]).where("first < doc").select("doc", "number", "first").distinct())
    held.drop()
    near.drop()
    return found


def linked(known: DataFrame, rare: int = RARE) -> DataFrame:
    """known: (doc, names).  (first, doc, rare): each document with each earlier one that is the first to hold a rare line or a run of
    it; the names of these rare lines."""
    held = known.select("doc", F.explode("names").alias("name"))
    line = F.col("name").bitwiseAND(1) == 1
    firsts = held.groupBy("name").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (~line | (F.col("n") <= rare)))
    pairs = held.join(cut(firsts.select("name", "first")), "name").where("first < doc")
    return pairs.groupBy("first", "doc").agg(F.collect_list(F.when(line, F.col("name"))).alias("rare"))


def overlaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, rare: int = RARE, rare_words: int = RARE_WORDS) -> DataFrame:
    """(id, text_hash, gone, sources): the numbers of the lines that go from each document that loses any, and the ids of
    the earlier documents that they stand in."""
    # one row for each document, so that the joins below are of plain tables and can be split where one document is hot
    known = Stored(sequences(docs, id_col, text_col, least, rare_words).dropDuplicates(["id", "text_hash"]))
    doc = F.struct("id", "text_hash")
    pairs = linked(known.df.select(doc.alias("doc"), "names"), rare)
    lines = lambda side, *more: known.df.select(doc.alias(side), F.struct("lines", "checks", *more).alias(f"{side}_lines"))
    both = pairs.join(lines("doc", "words", "numbers"), "doc").join(lines("first"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            side = lambda c, k, i: batch.column(c).field(k)[i].values.to_numpy()  # noqa: B023, E731
            for i in range(batch.num_rows):
                ids: dict[tuple[int, int], int] = {}
                a, b = ([ids.setdefault(x, len(ids)) for x in zip(side(c, 0, i).tolist(), side(c, 1, i).tolist(), strict=True)] for c in (2, 3))
                names = set(batch.column(4)[i].values.to_numpy().tolist())
                rare_ids = {x for x, name in zip(b, (mix(side(3, 0, i).view(np.uint64)) | np.uint64(1)).view(np.int64).tolist(), strict=True) if name in names}
                gone.append(side(3, 3, i)[aligned(a, b, side(3, 2, i), rare_ids, least)[0]].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["first", "doc", "gone"])

    found = both.select("first", "doc", "first_lines", "doc_lines", "rare").mapInArrow(run, f"first {_DOC}, doc {_DOC}, gone array<int>")
    out = cut(found.where(F.size("gone") > 0).select(F.col("doc.id").alias("id"), F.col("doc.text_hash").alias("text_hash"), "gone", F.col("first.id").alias("source")))
    known.drop()
    blocks = out.select(F.struct("id", "text_hash").alias("doc"), F.explode("gone").alias("number")).distinct()
    inside = _inside(docs, id_col, text_col, least, blocks)
    out = out.unionByName(inside.select("doc.id", "doc.text_hash", F.array("number").alias("gone"), F.col("first.id").alias("source")))
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")
    return out.groupBy("id", "text_hash").agg(merged, F.array_sort(F.collect_set("source")).alias("sources"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines whose numbers (from 0) are in ``gone``, in time linear in both; only texts that lose lines leave the JVM."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for old, out_ in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
            drop = set(out_ or ())
            out.append(None if old is None else "\n".join(x for i, x in enumerate(old.split("\n")) if i not in drop))
        return pa.array(out, pa.string())

    return F.coalesce(kept(F.when(gone.isNotNull(), text), gone), text)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, rare: int = RARE, rare_words: int = RARE_WORDS) -> DataFrame:
    """The rows of docs, all columns, in a struct ``row``, with the new text, the lines that went and their sources."""
    found = overlaps(docs, id_col, text_col, least, rare, rare_words)
    text = F.col(text_col).cast("string")
    tagged = docs.select(F.struct(*columns(docs)).alias("row"), text.alias("old"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"))
    joined = tagged.join(found, ["id", "text_hash"], "left")
    gone = F.coalesce(F.size("gone"), F.lit(0))
    return joined.select("row", "id", without(F.col("old"), F.col("gone")).alias("text"), F.when(gone > 0, gone).otherwise(0).cast("bigint").alias("n_removed_lines"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("source_ids"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, rare: int = RARE, rare_words: int = RARE_WORDS) -> DataFrame:
    """docs with the new text, every other column as it was."""
    return dedup(docs, id_col, text_col, least, rare, rare_words).select(F.col("row").withField(f"`{text_col}`", F.col("text")).alias("row")).select("row.*")
