"""Registered queries against their SQL, and the driver contract."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from lamina.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def same(df, sql, sf):
    with duckdb.connect() as db:
        for file in os.listdir(sf):
            db.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
        want = db.sql(sql).to_arrow_table()
    got = df.toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted(repr(tuple(r[c] for c in columns)) for r in t.to_pylist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.REGISTERED))
def test_query_matches_its_sql(spark, sf, name):
    query, sql = registry.REGISTERED[name]
    same(query(spark, sf), sql, sf)


def small_hot_tier(monkeypatch):
    """Each quarter of events is more than the hot tier takes, so all of it moves on at once, as with larger tables."""
    monkeypatch.setenv("LAMINA_HOT_MAX_RECORDS", "100")


@pytest.mark.parametrize("name", ["store_stats", "store_usage"])
def test_statistics_when_the_hot_tier_is_empty(spark, sf, monkeypatch, name):
    small_hot_tier(monkeypatch)
    query, sql = registry.REGISTERED[name]
    same(query(spark, sf), sql, sf)


def test_latest_batches_when_the_hot_tier_is_empty(spark, sf, monkeypatch):
    small_hot_tier(monkeypatch)
    query, sql = registry.REGISTERED["store_keep_latest"]
    same(query(spark, sf), sql, sf)


def test_entry_and_names(spark, sf):
    assert driver.entry(spark).count() == 10
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_imports_without_the_training_data_part(tmp_path, left):
    """What the driver does: the folders go, with the pipeline or without, and the rest works."""
    for item in ("__spark_entry__.py", "bench.py", "lamina", *left):
        subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lamina/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_all' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_training_data_part():
    for file in (ROOT / "lamina").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "lamina.llm" not in file.read_text(), file
