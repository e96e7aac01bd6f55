import corpus_pipeline
from sectorlake.llm import queries
from tests.llm.test_dedup import brute_lines, brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "minhash_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
            assert len({r.sequence_id for r in rows}) == len(rows)
            break
        assert out.columns == columns
        now = {r.doc_id: r.text for r in rows}
        assert set(now) <= set(before) and len(now) == len(rows)
        if name in ("quality_rules", "toxicity"):
            assert all(before[i] == t for i, t in now.items()) and 0 < len(now) < len(before)
        if name == "line_dedup":
            assert set(now) == set(before) and all(r.n_chars == len(r.text) for r in rows)
            assert now == {i: new for (i, _), (new, *_) in brute_lines(list(before.items())).items()}
        if name == "minhash_dedup":
            assert set(now) == {c for _, c in brute_near(sorted(before.items()))}
        docs, before = out, now
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_pipeline_takes_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_ten_queries():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
