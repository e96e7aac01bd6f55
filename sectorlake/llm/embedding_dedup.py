"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are rotated to the principal axes of all vectors.  Vectors link only at a distance of at most
``radius`` = sqrt(2 (1 - threshold)), so cells of that width along the first axes need to be compared with themselves
and their neighbours alone; a cell with many vectors is cut into tiles of bounded size, and each pair of tiles is one
group of work.  Within it the dot products gather the leading dimensions first; when the product so far plus the
product of the suffix norms cannot reach the threshold for a pair, the pair is dropped, and a tile pair stops when
none is left.  What survives is decided by the cosine of the vectors as given, in double precision.

Equal vectors of one label are one vector with a multiplicity before anything is compared.  A pair of tiles returns one
row for each vector that links there: its number of links and one vector of its part of the tile pair, so rows
grow with vectors and tiles, not with links.

Defined cases: a vector that is null, empty, all zero, or holds a null or non-finite component links with nothing, and
so does one with a null label or of another length; a null vec_id has no links and a null component; equal rows
link with each other like any two equal vectors, and rows with one vec_id share a component; an empty table gives an
empty result; vectors of any length are compared with those of their length; columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from sectorlake.llm.components import components, least_reached
from sectorlake.llm.session import cut

THRESHOLD = 0.93
TILE = 8192  # vectors in a tile
AXES = 2  # principal axes that cells are cut along
_CELL, _OTHER = [f"c{k}" for k in range(AXES)], [f"e{k}" for k in range(AXES)]
BLOCK = 16  # dimensions gathered at a step
_SLACK = 1e-5  # of bounds in single precision; the decision itself is in double precision and has none


def usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, the principal axes of all unit vectors, largest first: second moments are summed on the
    executors; the driver gets one matrix for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_length(batch.column(0)):
                u = _unit(x)
                sums[size] = sums.get(size, 0) + u.T @ u
        for size, s in sums.items():
            n = size * size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size)), pa.array(np.arange(n)), pa.array(s.ravel())], names=["size", "at", "value"])

    parts = vectors.select("vector").mapInArrow(run, "size bigint, at bigint, value double")
    out: dict[int, np.ndarray] = {}
    got = parts.groupBy("size", "at").agg(F.sum("value").alias("value")).toPandas()
    for size, g in got.groupby("size"):
        s = np.zeros(int(size) ** 2)
        s[g["at"].to_numpy()] = g["value"]
        _, v = np.linalg.eigh(s.reshape(int(size), int(size)))
        out[int(size)] = np.ascontiguousarray(v[:, ::-1])
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield int(size), rows, flat[begin[rows][:, None] + np.arange(size)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(vectors: DataFrame, rotation: Broadcast, radius: float) -> DataFrame:
    """The vectors with their length and their cell along the first axes: (size, c0, c1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.zeros((batch.num_rows, AXES), np.int64)
            sizes = np.zeros(batch.num_rows, np.int64)
            for size, rows, x in _by_length(batch.column(3)):
                y = _unit(x) @ rotation.value[size][:, :AXES]
                c[rows, : y.shape[1]] = np.floor(y / radius).astype(np.int64)
                sizes[rows] = size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), *(pa.array(c[:, k]) for k in range(AXES))], names=["key", "label", "weight", "vector", "size", *_CELL])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"key bigint, label {kinds['label']}, weight bigint, vector {kinds['vector']}, size bigint" + "".join(f", {c} bigint" for c in _CELL)
    return vectors.select("key", "label", "weight", "vector").mapInArrow(run, schema)


def compare(a: np.ndarray, b: np.ndarray | None, rotation: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) with a cosine of at least the threshold; b None: pairs i < j within a."""
    ra = _unit(a) @ rotation
    rb = ra if b is None else _unit(b) @ rotation
    suffix = lambda r: np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], 1)[:, ::-1]))
    sa, sb = suffix(ra), suffix(rb)
    first, size = min(BLOCK, ra.shape[1]), ra.shape[1]
    # the product of the suffix norms is one more dimension of the leading ones: one product gives the bound of every pair
    lead = lambda r, s: np.concatenate([r[:, :first], s[:, first : first + 1]], 1).astype(np.float32)
    la, lb = lead(ra, sa), lead(rb, sb).T
    found_i, found_j = [], []
    for lo in range(0, len(ra), 256):
        begin = 0 if b is not None else lo  # within one tile: the later vectors only
        rows, cols = np.nonzero(la[lo : lo + 256] @ lb[:, begin:] >= threshold - _SLACK)
        rows, cols = rows + lo, cols + begin
        partial = np.einsum("ij,ij->i", ra[rows, :first], rb[cols, :first])
        for d in range(first, size, BLOCK):
            e = min(d + BLOCK, size)
            partial = partial + np.einsum("ij,ij->i", ra[rows, d:e], rb[cols, d:e])
            reach = partial if e == size else partial + sa[rows, e] * sb[cols, e]
            keep = reach >= threshold - _SLACK
            rows, cols, partial = rows[keep], cols[keep], partial[keep]
            if not len(rows):
                break
        if b is None:
            rows, cols = rows[rows < cols], cols[rows < cols]
        for at in range(0, len(rows), 1 << 16):  # the decision: by the vectors as given
            i, j = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            x, y = a[i], (a if b is None else b)[j]
            x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
            cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            found_i.append(i[cosine >= threshold])
            found_j.append(j[cosine >= threshold])
    cat = lambda p: np.concatenate(p) if p else np.empty(0, np.int64)
    return cat(found_i), cat(found_j)


def link(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """vectors: (key bigint, label, vector array<double|float>, weight bigint), usable ones, one row for each key.

    Returns (key, links): the weight of the other vectors linked to each that has any, and (a, b): links that connect
    what all links connect."""
    spark = vectors.sparkSession
    rotation = axes(vectors)
    if not rotation:
        none = spark.createDataFrame([], "key bigint, links bigint")
        return none, none.select(F.col("key").alias("a"), F.col("links").alias("b"))
    radius = math.sqrt(2 * (1 - threshold)) * (1 + 1e-9)
    sent = spark.sparkContext.broadcast(rotation)  # one matrix for each length of vectors
    placed = cells(vectors, sent, radius)
    at = ["label", "size", *_CELL]
    tiles = placed.groupBy(*at).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = placed.join(tiles, at).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).drop("tiles")
    # every pair of neighbouring cells that exist, once; then every pair of their tiles, once
    offsets = F.array(*(F.struct(*(F.lit(d // 3**k % 3 - 1).alias(f"d{k}") for k in range(AXES))) for d in range(3**AXES)))
    around = tiles.withColumn("step", F.explode(offsets)).select(*at, F.col("tiles").alias("n"), *((F.col(c) + F.col(f"step.d{k}")).alias(e) for k, (c, e) in enumerate(zip(_CELL, _OTHER, strict=True))))
    other = tiles.select("label", "size", *(F.col(c).alias(e) for c, e in zip(_CELL, _OTHER, strict=True)), F.col("tiles").alias("n2"))
    mine, theirs = F.array(*_CELL), F.array(*_OTHER)
    pairs = around.join(other, ["label", "size", *_OTHER]).where(mine <= theirs)
    pairs = pairs.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    pairs = pairs.where((mine < theirs) | (F.col("tile") <= F.col("tile2"))).withColumn("work", F.struct(*_CELL, *_OTHER, "tile", "tile2"))
    alone = (mine == theirs) & (F.col("tile") == F.col("tile2"))
    first = pairs.select(*at, "tile", "work", F.lit(0).alias("side"))
    second = pairs.where(~alone).select("label", "size", *(F.col(e).alias(c) for c, e in zip(_CELL, _OTHER, strict=True)), F.col("tile2").alias("tile"), "work", F.lit(1).alias("side"))
    dealt = placed.join(first.unionByName(second), [*at, "tile"]).select("label", "size", "work", "side", "key", "weight", "vector")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iloc[0])
        one, two = (group[group["side"] == s].sort_values("key") for s in (0, 1))
        x = np.array(one["vector"].tolist(), float).reshape(-1, size)
        y = np.array(two["vector"].tolist(), float).reshape(-1, size) if len(two) else None
        i, j = compare(x, y, sent.value[size], threshold)
        j = j + (len(x) if y is not None else 0)
        key = np.concatenate([one["key"], two["key"]]).astype(np.int64)
        weight = np.concatenate([one["weight"], two["weight"]]).astype(np.int64)
        links = np.bincount(i, weight[j], len(key)) + np.bincount(j, weight[i], len(key))
        some = np.flatnonzero(links)
        return pd.DataFrame({"key": key[some], "links": links[some].astype(np.int64), "anchor": key[least_reached(len(key), i, j)[some]]})

    found = cut(dealt.groupBy("label", "size", "work").applyInPandas(run, "key bigint, links bigint, anchor bigint"))
    return found.groupBy("key").agg(F.sum("links").alias("links")), found.select(F.col("key").alias("a"), F.col("anchor").alias("b"))


def dedup(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """Per row: id_col, n_links, component_id, kept."""
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & usable(F.col("vector"))
    good = F.coalesce(good, F.lit(False))
    # one row for each different vector: the least id stands for it; an id may stand for several vectors, so the key is a number of its own
    same = rows.where(good).groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = cut(same.withColumn("key", F.monotonically_increasing_id()))
    links, edges = link(classes.select("key", "label", "vector", "weight"), threshold, tile)
    # links among ids: every id to the least of its vector, and the least of each vector to that of its anchor
    ids = rows.where(good).join(classes, ["label", "vector"]).select("id", "key", "least")
    name = classes.select("key", "least")
    across = edges.join(name.select(F.col("key").alias("a"), F.col("least").alias("x")), "a").join(name.select(F.col("key").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(across.unionByName(ids.select(F.col("id").alias("a"), F.col("least").alias("b"))))
    counts = classes.join(links, "key", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    wide = rows.withColumn("good", good).join(counts.withColumn("good", F.lit(True)), ["label", "vector", "good"], "left")
    out = wide.join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: The same rows in DuckDB SQL, for tables small enough for all pairs.
ORACLE_SQL = """
    WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS rn, vec_id, label, embedding FROM embeddings),
    good AS (SELECT rn, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM rows_ WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.rn, a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rn <> b.rn
        WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
    reach(x, y) AS (SELECT DISTINCT vec_id, vec_id FROM rows_ UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
    counted AS (SELECT rn, count(*) AS n FROM links GROUP BY rn)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
    FROM rows_ LEFT JOIN counted USING (rn) LEFT JOIN least ON vec_id = x"""
