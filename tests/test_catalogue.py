import duckdb
import pytest

import __spark_entry__ as entry
from sparkweft.plans import catalogue
from verify import normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import glob
    import os

    found = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return found


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.sql(catalogue.ORACLES[name])
    assert columns == sorted(result.columns)
    ours = sorted((tuple(normal(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(normal(v) for v in r) for r in con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
