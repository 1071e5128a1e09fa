"""Every registered query against its SQL twin on the small tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest
from conftest import DATA

from __spark_entry__ import entry, oracle_sql, queries
from shelfwise.plans.queries import QUERIES
from shelfwise.plans.twins import TWINS

FOLDER = f"{DATA}/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the shared tables are missing")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(queries()) and set(TWINS) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_twin(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cursor = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


SETTINGS = [
    {"spark.sql.shuffle.partitions": "1"},
    {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"},
]


@pytest.mark.parametrize("settings", SETTINGS)
@pytest.mark.parametrize(
    "name",
    ["whole_beans", "top_features", "spending_summary", "recommendation", "resolve_names",
     "resolve_order_keys", "options_by_roaster"],
)
def test_result_does_not_depend_on_the_plan(spark, duck, name, settings):
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = queries()[name](spark, FOLDER)
        cursor = duck.execute(oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
