"""Every registered query against its SQL, and what its plan must not contain."""

import os
import re

import pytest

from tablewright.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# No all-pairs joins and no Python on the data path.
FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"create view {table} as select * from '{DIRECTORY}/{table}.parquet'")
    return connection


def shown(value):
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIRECTORY)
    order = sorted(df.columns)
    ours = sorted(tuple(shown(row[c]) for c in order) for row in df.collect())
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == order
    theirs = sorted(tuple(shown(row[columns.index(c)]) for c in order) for row in cursor.fetchall())
    assert ours == theirs
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not FORBIDDEN.search(plan)
