"""The driver's contract, and that the library stands without the training-data operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_keys_match():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_library_without_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, timeout=120).returncode == 0


def test_nothing_else_imports_the_training_data_operators():
    for source in (ROOT / "tidewright").rglob("*.py"):
        if "llm" not in source.parts:
            assert not re.search(r"\bllm\b", source.read_text()), source


def test_whole_tables_equal_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    for name, source in (("ecdf_with_ties", "part"), ("bind_whole_tables", "orders")):
        rows = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect())
        with duckdb.connect() as db:
            db.execute(f"CREATE VIEW {source} AS SELECT * FROM '{folder}/{source}.parquet'")
            wanted = sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())
        assert rows == wanted and len(rows) == spark.read.parquet(f"{folder}/{source}.parquet").count()
