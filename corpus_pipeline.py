"""The corpus pipeline: quality rules, toxicity, line dedup, MinHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  A stage is written as Parquet and
reread before the next; all but the last return the columns of documents.

Defined cases: a null or empty text fails the quality rules; very long texts are rows like others; of documents that are near each
other the least doc_id stays; repeated rows of one doc_id and text count once after near-dedup; a row with a null doc_id passes every
stage that its text passes; an empty table gives empty stages; extra columns are passed on up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sectorlake.llm import line_dedup, minhash_dedup, packing, quality_rules, toxicity
from sectorlake.llm.bpe import vocabulary
from sectorlake.llm.session import Stored, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior or the base rules reject go."""
    return quality_rules.survivors(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on what is left of the labelled rows, takes for toxic go."""
    return toxicity.clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later document; n_chars follows the text."""
    columns = docs.columns
    return line_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash_dedup.survivors(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("line_dedup", lines), ("minhash_dedup", near), ("packing", pack)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        now = Stored(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
