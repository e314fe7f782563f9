"""Every registered query against its SQL in DuckDB, and without SQL against stated facts."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from reelmine.plans.registry import ORACLE
from reelmine.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLE[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"k12_anchor_repair"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
