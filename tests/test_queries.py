"""Every registered engine query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from millrace.queries import ORACLES, QUERIES

TABLES = "lineitem events conversations".split()


def plain(df):
    def one(v):
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return None
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)

    cols = sorted(df.columns)
    return cols, sorted(repr([one(v) for v in row]) for row in df[cols].astype(object).to_numpy().tolist())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        assert plain(got) == plain(db.sql(ORACLES[name]).df())
    else:
        assert len(got)
