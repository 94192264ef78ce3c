"""Every registered query against the SQL that states its result, on the smallest data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from check_queries import compare, oracle

from cdcgold.plans.catalog import QUERIES

ROOT = Path(__file__).resolve().parent.parent
DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(DIRECTORY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name].build(spark, DIRECTORY)
    sql = QUERIES[name].sql
    if sql is None:
        assert df.count() >= 0
    else:
        result = compare(con, df, sql)
        assert result.startswith("ok"), result


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("gone", [("cdcgold/llm", "corpus_pipeline.py"), ("cdcgold/llm",), ("corpus_pipeline.py",)])
def test_entry_without_training_operators(tmp_path, gone):
    """The contract of a copy of the library without its training-data package, its pipeline or both."""
    copy = tmp_path / "copy"
    for part in ("cdcgold", "corpus_pipeline.py", "__spark_entry__.py"):
        if part not in gone:
            source = ROOT / part
            ignored = shutil.ignore_patterns("__pycache__", *(g.removeprefix("cdcgold/") for g in gone if "/" in g))
            copy.mkdir(exist_ok=True)
            shutil.copytree(source, copy / part, ignore=ignored) if source.is_dir() else shutil.copy(source, copy)
    program = "import __spark_entry__ as c; q = c.queries(); print(len(q), set(c.oracle_sql()) <= set(q))"
    run = subprocess.run([sys.executable, "-c", program], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, known = run.stdout.split()
    assert int(n) >= len(QUERIES) and known == "True"
