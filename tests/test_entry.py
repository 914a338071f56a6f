import duckdb
import pytest

import __spark_entry__ as registered
from tools.compare import TABLES, compare


@pytest.fixture(scope="module")
def db(tiny):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tiny}/{name}.parquet')")
    return connection


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_its_sql(spark, db, tiny, name):
    verdict = compare(spark, db, name, tiny)
    assert verdict.startswith(("ok", "rows")), verdict
    assert "TYPES" not in verdict
