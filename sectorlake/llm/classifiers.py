"""What the toxicity and quality classifiers share: hashed terms, the labelled sample, and scoring.

Fitting reads a bounded sample of labelled rows (``sample_rows``, the smallest hashes of doc_id among the rows that may be learned
from).  Terms are counted on the executors; those that ``MIN_TEXTS`` texts of the sample hold are features, the ``TERMS`` most
frequent ones whatever their label.  The driver gets their counts and, for each text of the sample, the features that it holds:
at most ``TERMS`` bits, however long the text.  Scoring is one pass over all rows without a shuffle; the model that it sends to the
executors has the features that the fit left a weight or factors.

Defined cases: a null or empty text has no terms and gets the bias's score (with the structure features, those of an
empty text); a very long text is one row, its work linear; a label that is null is no label; of repeated labels of a doc_id the
larger counts, and of repeated rows of one the first by its terms; without labels, or with one class, every score is a constant;
repeated rows and ties get equal scores; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sectorlake.llm import fm
from sectorlake.llm.docstats import stats
from sectorlake.llm.session import Stored
from sectorlake.llm.textcore import Spans, chunks

SAMPLE_ROWS = 12_000
TERMS = 1 << 16  # features for terms at most
MIN_TEXTS = 5
_BYTE = np.arange(256)
_WORD = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128)
_FOLD = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: A term that a text holds so often is a feature of its own; the lower bits stay, so that one sieve finds all of a term's features.
LEVELS = {2: 0x5A300000, 3: 0x9C600000, 5: 0xE1700000}
_SIZE = 0x7E57  # of the features for the size of a text
BINS = 16
#: Structure statistics of a text: name -> (part, whole); sizes enter by their logarithm.
SHAPES = {
    "symbols": lambda s: s["n_symbols"] / np.maximum(s["n_words"], 1),
    "capitals": lambda s: s["n_upper"] / np.maximum(s["n_upper"] + s["n_lower"], 1),
    "repeats": lambda s: s["n_repeat_words"] / np.maximum(s["n_words"], 1),
    "dup_lines": lambda s: s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
    "word_length": lambda s: s["word_chars"] / np.maximum(s["n_words"], 1),
    "digits": lambda s: s["n_digits"] / np.maximum(s["word_chars"], 1),
    "punctuation": lambda s: s["n_punct"] / np.maximum(s["word_chars"], 1),
    "shouting": lambda s: s["n_bang_words"] / np.maximum(s["n_words"], 1),
    "variety": lambda s: s["n_distinct_words"] / np.maximum(s["n_words"], 1),
    "ended_lines": lambda s: s["n_ended_lines"] / np.maximum(s["n_lines"], 1),
    "words": lambda s: np.log1p(s["n_words"]),
    "lines": lambda s: np.log1p(s["n_lines"]),
    "chars": lambda s: np.log1p(s["n_chars"]),
}


def terms(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Row and 32-bit hash of every word (a run of letters, ASCII case folded) and of the first bytes of words with as many."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    data = _FOLD[data]
    word = np.append(_WORD[data], False)
    start = word[:-1].copy()
    start[1:] &= ~word[:-2]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = word[begins]
    starts = np.flatnonzero(start)
    end = word[:-1] & ~word[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = word[last]
    ends = np.flatnonzero(end) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    hasher = Spans(data).hash
    found_rows, found = [rows], [hasher(starts, ends) >> np.uint64(32)]
    for k in prefixes:
        longer = ends - starts >= k
        found_rows.append(rows[longer])
        found.append((hasher(starts[longer], starts[longer] + k) >> np.uint64(32)) ^ np.uint64(0x5BD1E995 + k))
    return np.concatenate(found_rows), np.concatenate(found).astype(np.uint32)


def leveled(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of terms, with features for repeated terms and for the size of each text, by row.

    sizes: the number of terms of each text."""
    key, times = np.unique(rows.astype(np.uint64) << np.uint64(32) | hashes, return_counts=True)
    found = [key] + [key[times >= n] ^ np.uint64(x) for n, x in LEVELS.items()]
    found.append(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32) | (np.log2(sizes + 1).astype(np.uint64) + np.uint64(_SIZE)))
    key = np.unique(np.concatenate(found))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shapes(s: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([f(s) for f in SHAPES.values()], 1)


@dataclass
class Model:
    names: np.ndarray  # the hashes of terms with a weight or factors, sorted
    machine: fm.Machine
    prefixes: tuple[int, ...] = ()
    edges: np.ndarray | None = None  # bin edges of the shapes
    sieve: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.names & 0xFFFFF] = True

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, hashes = terms(data, offsets, self.prefixes)
        sizes = np.bincount(rows, minlength=len(offsets) - 1)
        maybe = self.sieve[hashes & 0xFFFFF]
        rows, hashes = leveled(rows[maybe], hashes[maybe], sizes)
        at = np.searchsorted(self.names, hashes)
        hit = self.names[np.minimum(at, len(self.names) - 1)] == hashes if len(self.names) else np.zeros(len(at), bool)
        width = len(self.names) + 1
        key = np.unique(rows[hit] * width + at[hit])
        rows, features = key // width, key % width
        if self.edges is not None:
            more = len(self.names) + binned(shapes(stats(data, offsets)), self.edges)
            rows = np.concatenate([rows, np.repeat(np.arange(len(more)), more.shape[1])])
            features = np.concatenate([features, more.ravel()])
            order = np.argsort(rows, kind="stable")
            rows, features = rows[order], features[order]
        return rows, features

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.machine.score(*self.features(data, offsets), len(offsets) - 1)


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A feature number for each statistic: its bin."""
    return np.stack([k * BINS + np.searchsorted(edges[k], values[:, k], "right") for k in range(values.shape[1])], 1)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample_rows: int, structure: bool, prefixes: tuple[int, ...]) -> Stored:
    """(y, terms, shape) of the labelled sample, one row for each doc_id: distinct hashes and structure statistics as bytes."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    few = usable.groupBy(id_col).agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                rows, hashes = terms(data, offsets, prefixes)
                rows, raw = leveled(rows, hashes, np.bincount(rows, minlength=hi - lo))
                cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                shape = shapes(stats(data, offsets)) if structure else np.zeros((hi - lo, 0))
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                out = [*own, pa.array([raw[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([x.tobytes() for x in shape], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["id", "y", "terms", "shape"])

    # at most sample_rows rows of two numbers are broadcast: the documents stay where they are
    joined = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(few), id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = joined.select(id_col, "_y", "_text").mapInArrow(run, f"id {kind}, y int, terms binary, shape binary")
    return Stored(rows.groupBy("id").agg(F.min(F.struct("terms", "shape", "y")).alias("row")).select("row.*"))


def frequent(rows: DataFrame, most: int, least: int) -> np.ndarray:
    """The hashes (sorted) that ``least`` rows hold: the ``most`` most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(times.astype(np.int64))], names=["name", "times"])

    counted = rows.select("terms").mapInArrow(run, "name bigint, times bigint").groupBy("name").agg(F.sum("times").alias("times"))
    got = counted.where(F.col("times") >= least).orderBy(F.desc("times"), "name").limit(most).select("name").toArrow()
    return np.sort(got["name"].to_numpy().astype(np.uint32))


def held(rows: DataFrame, names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Labels, features and shapes of the sample's rows, in an order that does not depend on how they came in."""
    width = -(-max(1, len(names)) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                hashes = np.frombuffer(raw, np.uint32)
                at = np.searchsorted(names, hashes)
                at = at[names[np.minimum(at, len(names) - 1)] == hashes] if len(names) else at[:0]
                bits = np.zeros(8 * width, bool)
                bits[at] = True
                out.append(b"n" + at.astype("<u4").tobytes() if 4 * len(at) < width else b"b" + np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["y", "features", "shape"])

    got = rows.select("y", "terms", "shape").mapInArrow(run, "y int, features binary, shape binary").toArrow()
    found = sorted(zip(*(got[c].to_pylist() for c in ("features", "shape", "y")), strict=True))
    del got
    unpack = lambda f: np.flatnonzero(np.unpackbits(np.frombuffer(f, np.uint8, offset=1))).astype(np.uint32) if f[:1] == b"b" else np.frombuffer(f, "<u4", offset=1)
    return np.array([y for *_, y in found], float), [unpack(f) for f, *_ in found], np.array([np.frombuffer(s) for _, s, _ in found])


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", structure: bool = False, sample_rows: int = SAMPLE_ROWS, most: int = TERMS, least: int = MIN_TEXTS, positive_weight: float = 1.0, prefixes: tuple[int, ...] = ()) -> Model:
    rows = sample(docs, labels, label, id_col, text_col, sample_rows, structure, prefixes)
    names = frequent(rows.df, most, least)
    y, picked, shape = held(rows.df, names)
    rows.drop()
    edges, n = None, len(names)
    if structure:
        edges = np.quantile(shape, np.arange(1, BINS) / BINS, axis=0).T if len(shape) else np.zeros((len(SHAPES), BINS - 1))
        picked = [np.concatenate([p, (n + b).astype(np.uint32)]) for p, b in zip(picked, binned(shape, edges), strict=True)] if len(shape) else picked
        n += len(SHAPES) * BINS
    machine = fm.fit(picked, y, n, positive_weight=positive_weight)
    kept = np.union1d(np.union1d(np.flatnonzero(machine.weight), machine.factored), np.arange(len(names), n)).astype(np.int64)
    machine.factored, machine.weight = np.searchsorted(kept, machine.factored), machine.weight[kept]
    return Model(names[kept[kept < len(names)]], machine, prefixes, edges)


def apply(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, kept columns, held_out, score, predicted."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most TERMS features
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [id_col, *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                score = sent.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), pa.array(score)], names=[id_col, *keep, "score"])

    scored = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *keep).mapInArrow(run, f"{fields}, score double")
    return scored.select(id_col, *keep, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def below(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with a score under the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS features

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *(sent.value.score(data, offsets) for _, _, data, offsets in chunks(texts))]))

    return docs.where(score(F.col(text_col).cast("string")) < threshold)
