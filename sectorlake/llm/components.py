"""Connected components of a table of links.

Each round first contracts the links within tasks of bounded size (a task replaces its links by one from each node to the
least node they reach), then takes a large-star and a small-star step across tasks.  Links that fit one task are settled
by the contraction alone; more links take about as many rounds as the logarithm of their number.  Every table is cut off
from its lineage in the shared checkpoint folder.  A hot node costs no task more than its share: its least neighbour comes
from a pre-aggregated minimum, and the join that hands it out can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sectorlake.llm.session import cut

LINKS_A_TASK = 1_000_000
MAX_ROUNDS = 60


def least_reached(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node (0 to nodes - 1) the least node that the links (i, j) reach."""
    label = np.arange(nodes)
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(links: DataFrame, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """links: (a bigint, b bigint), any order, repeats allowed.  Returns (node, component): component is the least node
    that links reach.  Nodes without links to others are not in the result."""
    edges = cut(_contracted(links.where(F.col("a") != F.col("b")).select("a", "b")))
    state = None
    for _ in range(MAX_ROUNDS):
        now = _state(edges)
        if now == state:
            break
        state = now
        tasks = -(-now[0] // links_a_task)
        if tasks <= 1:
            edges = cut(_contracted(edges.coalesce(1)))
            break
        edges = cut(_contracted(_small_star(_large_star(edges)).coalesce(tasks)))
    else:
        raise RuntimeError("components did not settle")
    leaders = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(leaders).distinct()


def _contracted(links: DataFrame) -> DataFrame:
    """Of each task's links, one from every node but the least of its part to that least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def settle() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            names, at = np.unique(pairs, return_inverse=True)
            at = at.reshape(pairs.shape)
            label = least_reached(len(names), at[:, 0], at[:, 1])
            own = np.flatnonzero(label != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[label[own]])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
            size += batch.num_rows
            if size > 2 * LINKS_A_TASK:  # a task never holds more
                yield settle()
                held, size = [], 0
        if held:
            yield settle()

    return links.mapInArrow(run, "a bigint, b bigint")


def _oriented(links: DataFrame) -> DataFrame:
    """Each link once, with a > b."""
    some = links.where(F.col("a") != F.col("b"))
    return some.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.where(F.col("b") > F.col("a"))
    return _oriented(larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(others.unionByName(least.select("a", F.col("m").alias("b"))))
