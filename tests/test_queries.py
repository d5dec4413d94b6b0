"""Registered queries against their check SQL on a given small table."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a7_tag_entries"])
def test_query_returns_the_columns_and_rows_of_its_sql(spark, name):
    df = entry.queries()[name](spark, DATA)
    con = duckdb.connect()
    for table in ("part",):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    assert df.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
