import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df) -> list[tuple]:
    """All rows, in an order that doesn't depend on the plan."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(sql: str, sf_dir: str = SF) -> tuple[list[str], list[tuple]]:
    """Column names and rows of a DuckDB query over the tables of ``sf_dir``."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    frame = con.execute(sql).to_arrow_table()
    return frame.column_names, [tuple(r.values()) for r in frame.to_pylist()]


def same_rows(df, sql: str, sf_dir: str = SF) -> None:
    names, expected = duck(sql, sf_dir)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(names) == sorted(df.columns)
    # NaN isn't equal to itself, so it is compared as text
    plain = lambda rs: sorted((tuple(str(v) if v != v else v for v in r) for r in rs), key=repr)
    assert plain(got) == plain(expected)
