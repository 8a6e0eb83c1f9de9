"""Queries that give samples in thousandths, against DuckDB on samples that are halves of a thousandth once they are floats."""

import duckdb
import numpy as np
import pytest

from vanika.plans import catalogue

#: Of these, -0.2765 and others are a little under the half as doubles, and the half as floats.
SAMPLES = [-0.2765, 0.1925, -0.1475, -0.1335, -0.2435, -0.1555, 0.2765, 0.1475]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("halves"))
    rng = np.random.default_rng(7)
    rows = [(k, [float(np.float32(x)) for x in (SAMPLES * 8 if k < 8 else (rng.integers(-600, 600, 64) + 0.5) / 1000)]) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    turns = [(k, t, "user", "x" * (4 * (k + t) % 24)) for k in range(40) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["collated_batches", "interval_samples", "segment_clips", "stretched_samples", "trimmed_samples"])
def test_halves(spark, folder, name):
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    theirs = sorted(map(str, cursor.fetchall()))
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in catalogue.queries()[name](spark, folder).collect()))) == theirs
