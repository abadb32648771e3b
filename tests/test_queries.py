"""Every query with SQL gives DuckDB's rows; the others run."""

import math

import duckdb
import pytest

from tabulon.plans import queries as plans
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(frame, columns):
    return sorted(tuple("null" if v is None else value(v.item() if hasattr(v, "item") else v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert name in plans.ORACLES
    want = duck.sql(plans.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
