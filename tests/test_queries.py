import duckdb
import pytest

import __spark_entry__ as registered
import check
from callglass.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
NAMES = [q.name for q in catalogue.ALL]
ROWS_ONLY = {"redacted_documents", "redaction_counts"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in ("events", "conversations", "documents"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    result, _ = check.compare(spark, con, FOLDER, name, registered.oracle_sql().get(name))
    assert not result.startswith("FAIL"), result


def test_only_these_have_no_sql():
    assert set(NAMES) - set(registered.oracle_sql()) == ROWS_ONLY


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_no_python_workers_in_any_plan(spark):
    for name in NAMES:
        run = registered.queries()[name]
        if name.startswith(("stored_", "live_", "streamed_", "logs_page_2")):
            continue
        text = run(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in text and "CartesianProduct" not in text and "Join Cross" not in text, name
