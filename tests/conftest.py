import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false", "spark.default.parallelism": "8",
    }
    session = SparkSession.builder.master("local[8]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A connection with the small tables as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def small():
    return SMALL


def _plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "" if v is None else str(v)


@pytest.fixture(scope="session")
def same():
    """Assert that a Spark result and a DuckDB relation hold the same rows, columns by name."""

    def check(df, rel):
        names = sorted(df.columns)
        assert names == sorted(rel.columns)
        order = [rel.columns.index(n) for n in names]
        got = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
        want = sorted(tuple(_plain(r[i]) for i in order) for r in rel.fetchall())
        assert got == want

    return check
