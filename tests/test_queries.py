"""Every query against its SQL on the driver's smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from marketloom.plans import registry
from marketloom.sources.fixtures import BASE, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def cells(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, pd.Timestamp | datetime.datetime):
            return str(pd.Timestamp(x).tz_localize(None))[:19].replace(" 00:00:00", "")
        return f"{float(x):.5f}".replace("-0.00000", "0.00000") if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_recovered_volatility(spark):
    df = registry.queries()["o03_implied_vol"](spark, DATA)
    assert df.where("found is not null and abs(found - iv) > 0.002").isEmpty()
    assert df.where("found is null").count() < 0.05 * df.count()


def test_pnl_curve_has_every_closed_trade(spark):
    got = registry.queries()["w28_pnl_curve_all"](spark, DATA).toPandas()
    closed = table(spark, DATA, "trades").where("status = 'CLOSED'")
    assert closed.select("ticker").distinct().count() > 1
    assert sorted(got["id"]) == sorted(r.id for r in closed.select("id").collect())
