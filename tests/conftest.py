import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf_dir):
    """A DuckDB connection with the tables of sf_dir as views."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def same_rows(frame, con, sql):
    """Compare a DataFrame with the rows of a SQL text, by column name and without order."""
    rows, columns = [tuple(r) for r in frame.collect()], frame.columns
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    key = lambda row: tuple("" if v is None else str(v) for v in row)
    other = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(map(key, rows)) == sorted(map(key, other))
