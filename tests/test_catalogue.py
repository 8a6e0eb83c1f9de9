"""Every query of the catalogue against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from vanika.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    return "None" if math.isnan(float(value)) else repr(round(float(value), 6) + 0.0)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    ours = sorted([plain(r[c]) for c in sorted(df.columns)] for r in df.collect())
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    theirs = sorted([plain(dict(zip(columns, r))[c]) for c in sorted(columns)] for r in cursor.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
