import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", f"file://{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf: str = SF, **frames):
    """DuckDB with the tables of a folder as views; frames (pandas) take their place."""
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf).iterdir()):
        if p.stem not in frames:
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, frame in frames.items():
        con.register(name, frame)
    return con


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def same(df, con, sql: str) -> None:
    """df has the rows of the SQL, in any order."""
    result = con.sql(sql)
    columns = sorted(result.columns)
    assert sorted(df.columns) == columns
    at = [result.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == want
