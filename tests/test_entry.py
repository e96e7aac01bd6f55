import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sectorlake.plans import contract

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(contract.SQL))
def test_against_sql(spark, oracle, tmp_path, name):
    df = contract.QUERIES[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    columns = ", ".join(sorted(df.columns))
    mine, theirs = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", f"SELECT {columns} FROM ({contract.SQL[name]})"
    assert oracle.execute(f"SELECT count(*) FROM (({mine} EXCEPT ALL {theirs}) UNION ALL ({theirs} EXCEPT ALL {mine}))").fetchall() == [(0,)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "sectorlake"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    package = tmp_path / "sectorlake"
    package.mkdir()
    for name in os.listdir(f"{ROOT}/sectorlake"):
        if name != "llm":
            os.symlink(f"{ROOT}/sectorlake/{name}", package / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import shutil; import __spark_entry__ as e; print(len(e.queries()))"
    copy = tmp_path / "__spark_entry__.py"
    text = open(f"{ROOT}/__spark_entry__.py").read()
    copy.unlink()
    copy.write_text(text)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""})
    assert done.returncode == 0 and int(done.stdout) == len(contract.QUERIES), done.stderr
