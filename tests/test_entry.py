import duckdb
import pytest

import __spark_entry__ as e
from factloom import bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(str(int(v)) if isinstance(v, float) and v.is_integer() else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(bindings.SQL))
def test_against_sql(spark, duck, name):
    got, want = bindings.QUERIES[name](spark, SF).toPandas(), duck.execute(bindings.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = got[columns].astype(object).where(got[columns].notna(), None), want[columns].astype(object).where(want[columns].notna(), None)
    assert rows(a) == rows(b)
