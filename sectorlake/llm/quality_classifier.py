"""Quality: a factorisation machine over hashed words, structure statistics and sizes.

Each structure statistic is one of ``BINS`` features by the quantiles of the sample; the machine's factors combine
them with each other and with the words.  Fitting, scoring and the defined cases: see ``classifiers``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sectorlake.llm import classifiers

THRESHOLD = 0.5


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = classifiers.SAMPLE_ROWS) -> classifiers.Model:
    return classifiers.fit(docs, labels, label, structure=True, sample_rows=sample_rows)


def score(docs: DataFrame, model: classifiers.Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, held_out, score, predicted (1: good)."""
    return classifiers.apply(docs, model, threshold, keep=keep)
