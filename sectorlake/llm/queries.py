"""The queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sectorlake.llm import byte_bpe, embedding_dedup, html_extract, licenses, line_dedup, minhash_dedup, packing, quality_classifier, quality_rules, toxicity
from sectorlake.llm.bpe import vocabulary
from sectorlake.llm.session import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(read(spark, sf_dir, "embeddings"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(found["row.doc_id"].alias("doc_id"), "n_removed_lines", "source_ids", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_html_extraction, op3_license_scan, op4_packing, op5_embedding_dedup, op6_minhash_dedup, op7_quality_rules, op8_byte_bpe, op9_quality_classifier, op10_line_dedup)}


#: Near-duplicates by brute force (a shingle weighs as often as it occurs): every pair that shares a shingle, for tables small enough for that.
NEAR_SQL = r"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words) GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(c) AS n FROM shingles GROUP BY 1),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * k >= 4 * (p.n + q.n - k)),
    both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT doc_id, (SELECT min(doc_id) FROM words WHERE len(w) = 0) FROM words WHERE len(w) = 0),
    reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
    classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
    SELECT doc_id, class_id, doc_id = class_id AS kept FROM documents JOIN classes ON doc_id = x"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.oracle(), "op5_embedding_dedup": embedding_dedup.ORACLE_SQL, "op6_minhash_dedup": NEAR_SQL}
