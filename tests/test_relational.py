import duckdb
import pytest

from tidegrid.plans import relational
from tidegrid.sources import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(relational.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(relational.SQL[name])
    cols = [d[0] for d in want.description]
    df = relational.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(want.fetchall())
