import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def duck():
    import duckdb

    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TINY}/{table}.parquet'")
    return con


def norm(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


def same_rows(df, con, sql):
    """Compare a frame with a query's rows, columns by name and rows in any order."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert ours == theirs
