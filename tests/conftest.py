import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of a folder, or over data frames by name."""
    import duckdb

    def run(sql, sf=None, **frames):
        c = duckdb.connect()
        for p in Path(sf).iterdir() if sf else ():
            c.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
        for name, f in frames.items():
            c.register(name, f)
        return c.execute(sql).df()

    return run


def rows(frame, columns):
    f = frame[columns].astype(object)
    clean = lambda v: None if v is None or v is pd.NA or v != v else (int(v) if isinstance(v, float) and v.is_integer() else v)
    return sorted((tuple(clean(v) for v in r) for r in f.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a, sorted(a.columns)) == rows(b, sorted(b.columns))

    return check
