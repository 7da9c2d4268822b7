"""Every registered query against its SQL on the smallest tables."""

import datetime
import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Fitted models take longest; the tests of their own files cover them. Queries of the pipeline
# operators are tested beside those.
SLOW = {"topic_model", "project_new_rows", "stream_score", "manifold_fit", "manifold_supervised", "hdbscan_predict", "topic_model_rows", "topic_model_graph", "manifold_neighbours"}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def own_query(name):
    return name not in SLOW and name != "pipeline" and not re.match(r"op\d+_", name)


@pytest.mark.parametrize("name", sorted(filter(own_query, entry.queries())))
def test_query(spark, duck, folder, name):
    frame = entry.queries()[name](spark, folder)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == rows(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
