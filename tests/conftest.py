import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ.setdefault("PYTHONPATH", sys.path[0])
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same_as_duckdb(spark):
    """Runs a query and its SQL over a folder and compares columns and rows."""
    import duckdb

    def check(query, sql, folder="/root/testdata/sf0.001"):
        c = duckdb.connect()
        for name in os.listdir(folder):
            c.sql(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
        df, want = query(spark, folder), c.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        rows = lambda found: sorted((tuple(map(_plain, r)) for r in found), key=str)
        assert rows(df.select(*(f"`{x}`" for x in cols)).collect()) == rows(want.select(*(f'"{x}"' for x in cols)).fetchall())

    return check
