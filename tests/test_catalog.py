"""Each registered query with SQL gives what DuckDB gives on the same tables."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagelight.functions import scalar

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    names = sorted(got.columns)
    order = [rel.columns.index(c) for c in names if c in rel.columns]
    assert sorted(rel.columns) == names
    want = sorted(repr(tuple(tidy(r[i]) for i in order)) for r in rel.fetchall())
    assert sorted(repr(tuple(tidy(r[c]) for c in names)) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_json_escape_of_control_characters(spark):
    text = "".join(map(chr, range(0x30))) + "\\ é"
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(scalar.escape_json(F.col("text"))).first()[0]
    assert json.loads(f'"{got}"') == text and "\\u0000" in got and "\\u001F" in got
