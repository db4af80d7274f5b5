"""Every query that has SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from courtline.plans import catalogue, entities, observations, projects  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", [*catalogue.QUERIES])
def test_rows(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalogue.SQL:
        rel = duck.sql(catalogue.SQL[name])
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_sampling_goes_to_the_end(spark):
    d = "/root/testdata/sf0.1"
    frames = spark.read.parquet(f"{d}/events.parquet").where("event_id % 10 = 0")
    got = catalogue.QUERIES["fixed_rate_sampling_whole"](spark, d)
    assert got.count() == frames.count() > 500
    assert got.agg({"frame": "max"}).first()[0] == frames.agg({"event_id": "max"}).first()[0] > 5000
