import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("without", [(), ("corpus_pipeline.py",)])
def test_the_rest_loads_without_the_text_operators(tmp_path, without):
    """With their folder gone, with and without the file of their pipeline."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "glyphist", tmp_path / "glyphist", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if (ROOT / "corpus_pipeline.py").exists() and not without:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    from glyphist.plans.registry import QUERIES

    assert done.stdout.split() == [str(len(QUERIES)), "False"], done.stderr


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, sf):
    df = entry.entry(spark)
    assert df.columns == ["id", "word", "n", "freq"] and df.count() > 0


def test_oracle_sample(spark, sf):
    """A few queries against DuckDB; checks/compare.py runs all of them."""
    import duckdb

    from checks.compare import TABLES, rows_of

    duck = duckdb.connect()
    for name in TABLES:
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("assign_words_embedding", "histogram_long_events", "entity_labels", "areas_by_label"):
        df = entry.queries()[name](spark, sf)
        answer = duck.sql(entry.oracle_sql()[name])
        assert rows_of(df.columns, df.collect()) == rows_of(answer.columns, answer.fetchall()), name
