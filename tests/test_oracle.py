"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, float | np.floating):
        return float(f"{x:.9g}")
    return int(x) if isinstance(x, int | np.integer) else x


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str([cell(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(ORACLE[name])
    assert mine == normal([d[0] for d in found.description], found.fetchall())


def test_division_and_orphans(spark):
    found = entry.queries()["G20_implementations"](spark, DIR).collect()
    made = {(r.type[:4], r.type[4:] == r.interface) for r in found if r.type[0] != "t"}
    assert ("all:", True) in made and ("few:", True) not in made
    rows = entry.queries()["D04_without_orphans"](spark, DIR)
    assert rows.select("kind").distinct().count() > 3 and rows.where("'nowhere' in (source, target)").isEmpty()


def test_sql_carries_only_what_it_needs():
    from meshquery.oracle.carrier import sql

    assert sql("SELECT 1") == "SELECT 1"
    text = sql("SELECT * FROM item")
    assert "lineitem" in text and "ext_names" not in text and "RECURSIVE" not in text
    assert "RECURSIVE" in sql("SELECT * FROM r", "r(n) AS (SELECT 1 UNION SELECT n + 1 FROM r WHERE n < 3)")


def test_every_query_without_sql_runs(spark):
    for name, f in entry.queries().items():
        if name not in ORACLE and not name.startswith("op") and name != "pipeline":
            assert f(spark, DIR).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
