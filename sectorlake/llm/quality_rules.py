"""Quality rules under weak supervision.

Each rule votes for (+1) or against (-1) a document or abstains (0).  The rules overlap and their bounds are tight, so that single
votes are often wrong.  The votes of all documents are counted by pattern; expectation-maximisation over these counts estimates how
often each rule gives each vote on good and on bad documents, and a document is kept when its posterior probability of being good
reaches one half, whatever single rules say.  It is run from several starts, and the likeliest outcome counts.  The texts are read
once; the counts have at most 3 ** len(RULES) rows, whatever the input, and so has the table that is joined back.

Defined cases: a null text is an empty text, without words; a rule without what it measures abstains; repeated rows
vote once each and get equal results; a posterior right at the threshold keeps; a very long text is one row, its work linear; an empty table gives an empty result; columns
other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sectorlake.llm.docstats import stats
from sectorlake.llm.session import cut
from sectorlake.llm.textcore import chunks

#: name, what is measured, against beyond (side, bound), for within (side, bound); between the bounds a rule abstains.
RULES = [
    ("symbols", lambda s: (s["n_symbols"], s["n_words"]), (">", 0.10), ("<", 0.02)),
    ("symbol_chars", lambda s: (s["n_symbols"], s["word_chars"]), (">", 0.06), ("<", 0.01)),
    ("punctuation", lambda s: (s["n_punct"], s["word_chars"]), (">", 0.06), ("<", 0.05)),
    ("repeats", lambda s: (s["n_repeat_words"], s["n_words"]), (">", 0.10), ("<", 0.05)),
    ("dup_lines", lambda s: (s["n_dup_lines"], s["n_lines"]), (">", 0.18), ("<", 0.10)),
    ("capitals", lambda s: (s["n_upper"], s["n_upper"] + s["n_lower"]), (">", 0.10), ("<", 0.05)),
    ("shouting", lambda s: (s["n_bang_words"], s["n_words"]), (">", 0.05), ("<", 0.01)),
    ("letters", lambda s: (s["n_upper"] + s["n_lower"] + s["n_high"], s["word_chars"]), ("<", 0.80), (">", 0.87)),
    ("variety", lambda s: (s["n_distinct_words"], s["n_words"]), ("<", 0.60), (">", 0.65)),
    ("word_length", lambda s: (s["word_chars"], s["n_words"]), (">", 6.5), ("<", 6.0)),
    ("digits", lambda s: (s["n_digits"], s["word_chars"]), (">", 0.04), ("<", 0.02)),
    ("endings", lambda s: (s["n_ended_lines"], s["n_lines"]), ("<", 0.90), (">", 0.95)),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One column per rule."""
    out = np.zeros((len(s["n_words"]), len(RULES)), np.int8)
    for k, (_, measure, (bad_side, bad), (good_side, good)) in enumerate(RULES):
        part, whole = measure(s)
        share = part / np.maximum(whole, 1)
        against = share > bad if bad_side == ">" else share < bad
        favour = share > good if good_side == ">" else share < good
        out[:, k] = np.where(whole > 0, favour.astype(np.int8) - against.astype(np.int8), 0)
    return out


def measured(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id_col and kept columns, the counts of the whole text, and the pattern of votes as a base-3 number."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [id_col, *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                s = stats(data, offsets)
                pattern = (votes(s).astype(np.int64) + 1) @ (3 ** np.arange(len(RULES)))
                columns = [c.slice(lo, hi - lo) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(s[c].astype(np.int64)) for c in COUNTS] + [pa.array(pattern)], names=[id_col, *keep, *COUNTS, "pattern"])

    source = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *keep)
    return source.mapInArrow(run, fields + "".join(f", {c} bigint" for c in COUNTS) + ", pattern bigint")


def estimate(patterns: dict[int, int], rounds: int = 500, tolerance: float = 1e-6) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of each pattern, P(vote | class) as (rule, class bad/good, vote -1/0/+1), and the share of good.

    The starts: the majority of the votes, their mean, and each rule alone.  Each runs for a tenth of the rounds; the likeliest goes on
    until it settles.  Good is the class with more votes for."""
    if not patterns:
        return {}, np.zeros((len(RULES), 2, 3)), 0.5
    code = np.array(sorted(patterns))
    weight = np.array([patterns[c] for c in code.tolist()], float)
    vote = code[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1
    starts = [np.where(vote.sum(1) > 0, 0.9, 0.1), 0.5 + 0.45 * vote.mean(1), *(0.5 + 0.4 * vote.T)]
    cast = (vote[:, :, None] == [-1, 0, 1]).reshape(len(code), -1).astype(float)  # a column for each rule and vote
    first = max((_maximise(cast, weight, s, rounds // 10, tolerance) for s in starts), key=lambda x: round(x[3], 3))[0]
    good, table, prior, _ = _maximise(cast, weight, first, rounds, tolerance)
    if (table[:, 1, 2] - table[:, 0, 2]).sum() < 0:
        good, table, prior = 1 - good, table[:, ::-1], 1 - prior
    return dict(zip(code.tolist(), good.tolist(), strict=True)), table, prior


def _maximise(cast: np.ndarray, weight: np.ndarray, good: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Expectation-maximisation from one start; counts are smoothed by one observation.  The last value is the log-likelihood."""
    for _ in range(rounds):
        share = np.stack([1 - good, good])
        table = ((share * weight) @ cast).reshape(2, -1, 3).swapaxes(0, 1) + 1
        table /= table.sum(2, keepdims=True)
        prior = float(np.clip((weight * good).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        bad_log, good_log = np.log([[1 - prior], [prior]]) + np.log(table).swapaxes(0, 1).reshape(2, -1) @ cast.T
        new = 1 / (1 + np.exp(np.clip(bad_log - good_log, -500, 500)))
        done, good = np.abs(new - good).max() < tolerance, new
        if done:
            break
    return good, table, prior, float((weight * np.logaddexp(bad_log, good_log)).sum())


def accuracies(table: np.ndarray, prior: float) -> dict[str, float]:
    """Of each rule, the estimated share of its votes that are right."""
    right = prior * table[:, 1, 2] + (1 - prior) * table[:, 0, 0]
    wrong = prior * table[:, 1, 0] + (1 - prior) * table[:, 0, 2]
    return {name: float(a / (a + b)) for (name, *_), a, b in zip(RULES, right, wrong, strict=True)}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """id_col, kept columns, the counts, base_failed, quality (the posterior) and kept."""
    spark = docs.sparkSession
    rows = cut(measured(docs, id_col, text_col, list(keep)))
    counted = {r[0]: r[1] for r in rows.groupBy("pattern").count().collect()}  # at most 3 ** len(RULES) rows
    posterior, _, _ = estimate(counted)
    table = spark.createDataFrame(list(posterior.items()) or [(-1, 0.0)], "pattern bigint, quality double")
    scored = rows.join(F.broadcast(table), "pattern").withColumn("base_failed", base_failed())
    return scored.select(id_col, *keep, *COUNTS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))


def survivors(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that are kept.  The texts are read twice and cross no shuffle."""
    none = docs.select(F.lit(0).alias("_id"), F.col(text_col).alias("_text"))
    counted = {r[0]: r[1] for r in measured(none, "_id", "_text", []).groupBy("pattern").count().collect()}  # at most 3 ** len(RULES) rows
    posterior, _, _ = estimate(counted)
    known = np.array(sorted(posterior), np.int64)
    good = np.array([posterior[p] for p in known.tolist()])

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        out = [np.empty(0, bool)]
        for _, _, data, offsets in chunks(texts):
            s = stats(data, offsets)
            pattern = (votes(s).astype(np.int64) + 1) @ (3 ** np.arange(len(RULES)))
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            out.append(~failed & (good[np.searchsorted(known, pattern)] >= threshold))
        return pa.array(np.concatenate(out))

    return docs.where(kept(F.col(text_col).cast("string")))
