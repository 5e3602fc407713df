"""A sample of the registered queries against DuckDB at the smallest scale.

``python -m checks.compare FOLDER`` runs all of them.
"""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [
    "findings_per_source", "minimal_exclusions", "detect_config", "detect_fallback", "concat_go", "number_tokens",
    "apply_ignores", "cases_read", "precision_recall_by_group", "exploratory_by_file", "stream_scan",
])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, answer.fetchall())


def test_entry_and_oracle_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
