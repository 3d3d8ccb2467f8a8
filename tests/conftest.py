import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    yield con
    con.close()


def _plain(v):
    import datetime
    import decimal

    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.7g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture()
def same():
    """Compare a DataFrame with a DuckDB result: column names, and rows in any order."""

    def check(df, result):
        names = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        ours = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
        theirs = sorted(tuple(_plain(dict(zip(names, r))[c]) for c in order) for r in result.fetchall())
        assert ours == theirs

    return check
