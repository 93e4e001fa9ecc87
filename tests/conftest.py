import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tarnbridge.session import prepared

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepared(session)
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        path = f"{f}/*.parquet" if f.is_dir() else f
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{path}')")
    return c


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(columns, rows):
    """Rows as sorted tuples by column name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="session")
def same_rows():
    def check(df, relation):
        assert sorted(df.columns) == sorted(relation.columns)
        assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())

    return check
