import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def cell(v):
    import pandas as pd

    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if pd.isna(v):
        return ""
    if isinstance(v, pd.Timestamp):
        return str(v.tz_convert("UTC").tz_localize(None) if v.tz else v)
    if isinstance(v, str):
        return v
    f = round(float(v), 6)
    return str(int(f)) if f == int(f) else str(f)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False))


def check_against_sql(spark, duck, queries, sql, name):
    """A query's rows on the smallest data are those of its SQL."""
    got = queries[name](spark, "/root/testdata/sf0.001").toPandas()
    assert rows_of(got) == rows_of(duck.execute(sql[name]).df())
