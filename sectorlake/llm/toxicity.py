"""Toxicity: a factorisation machine over hashed terms.

Terms are words and word beginnings, so an inflected insult still counts, and terms that a text repeats; the machine's
pairwise factors learn what terms mean together.  Fitting, scoring and the defined cases: see ``classifiers``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sectorlake.llm import classifiers

THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)  # bytes of word beginnings
POSITIVE_WEIGHT = 3.0  # a missed toxic document costs as much as three clean ones


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = classifiers.SAMPLE_ROWS) -> classifiers.Model:
    return classifiers.fit(docs, labels, label, sample_rows=sample_rows, positive_weight=POSITIVE_WEIGHT, prefixes=PREFIXES)


def score(docs: DataFrame, model: classifiers.Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, held_out, score, predicted (1: toxic)."""
    return classifiers.apply(docs, model, threshold, keep=keep)


def clean(docs: DataFrame, model: classifiers.Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    return classifiers.below(docs, model, threshold)
