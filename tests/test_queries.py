"""Every registered query against its SQL in DuckDB, and the shape of its plan."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

from clinicflow.plans.oracle import ORACLE
from clinicflow.plans.queries import QUERIES
from clinicflow.sources.driver_tables import SOURCES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in SOURCES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    yield connection
    connection.close()


def comparable(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(f"{type(row[i]).__name__}:{row[i]}" for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, str(DATA))
    expected = duck.execute(ORACLE[name])
    columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert comparable(result.columns, result.collect()) == comparable(columns, expected.fetchall())


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_plans_have_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("missing", ["clinicflow.llm.queries", "corpus_pipeline", "zstandard"])
def test_entry_point_without_optional_parts(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith("clinicflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(QUERIES) <= set(module.queries())
    assert "pipeline" not in module.queries()


def test_entry_point(spark):
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
    assert set(QUERIES) <= set(module.queries())
