import glob
import os
import sys

import numpy as np
import pyarrow as pa
import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])  # for workers
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    out = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df) -> list[tuple]:
    """All rows as comparable tuples with columns by name, sorted."""
    names = sorted(df.column_names if isinstance(df, pa.Table) else df.columns)

    def plain(v):
        """(kind, value): null, an empty string, a whole number and a fraction all differ; 1 and 1.0 of numeric types too."""
        if v is None:
            return ("null", "")
        if isinstance(v, bool | np.bool_):
            return ("bool", str(bool(v)))
        if isinstance(v, int | np.integer):
            return ("whole", str(int(v)))
        if isinstance(v, float | np.floating):
            return ("fraction", "nan" if v != v else repr(round(float(v), 9)))
        if isinstance(v, bytes | bytearray):
            return ("bytes", bytes(v).hex())
        return (type(v).__name__, str(v))

    if hasattr(df, "collect"):
        return sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    # DuckDB's rows as an Arrow table: pandas would turn whole numbers beside nulls into fractions
    return sorted(tuple(plain(v) for v in r) for r in zip(*(df.column(c).to_pylist() for c in names)))
