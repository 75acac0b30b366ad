"""Every registered query of the engine against DuckDB on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from talewarp.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = []
    for row in rows:
        out.append(tuple(repr(round(row[k], 5)) if isinstance(row[k], float) else str(row[k].replace(tzinfo=None)) if isinstance(row[k], datetime.datetime) else str(row[k]) for k in order))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    rows = frame.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert plain(rows, frame.columns) == plain(cursor.fetchall(), columns)
