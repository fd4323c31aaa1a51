"""Every registered query of the recordings engine against its SQL, or against its promise where SQL has none."""

import math

import duckdb
import pytest

from chronolith.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "none"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio"):
        return f"{float(value):.9g}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canon(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rel = db.sql(registry.ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
