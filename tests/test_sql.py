"""Every query that has SQL gives the rows of its SQL; the others give rows."""

import pytest
from sqlcheck import connection, rows

from veristrata import catalog, records
from veristrata import queries as core

QUERIES = core.QUERIES | catalog.QUERIES | records.QUERIES
ORACLE = core.ORACLE | catalog.ORACLE | records.ORACLE


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name in ORACLE:
        assert rows(got) == rows(con.sql(ORACLE[name]).to_df())
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
