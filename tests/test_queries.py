"""Every query with SQL returns the rows that DuckDB returns on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from cutloom import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def text(v):
        if isinstance(v, (list, np.ndarray)):
            return repr([*v])
        return None if v is None or pd.isna(v) else str(v)

    frame = frame[sorted(frame.columns)].map(text)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    mine = plans.QUERIES[name](spark, DATA)
    theirs = duck.sql(plans.ORACLE_SQL[name])
    assert {c: KINDS.get(k, k) for c, k in mine.dtypes} == dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    pd.testing.assert_frame_equal(rows(mine.toPandas()), rows(theirs.df()))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_others_run(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["seq_id", "n", "ord", "source_id", "source_frame"]
    assert frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
