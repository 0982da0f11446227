import glob
import math
import os
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.local.dir", str(tmp_path_factory.mktemp("local"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).parents[1])
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def _plain(v):
    import decimal

    import numpy as np
    import pandas as pd

    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(_plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, int, np.floating, np.integer, decimal.Decimal)):
        return None if isinstance(v, (float, np.floating)) and math.isnan(v) else float(f"{float(v):.9g}") if abs(v) < 2**53 else int(v)
    return str(v)


def rows_of(frame, columns):
    return Counter(tuple(_plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture
def same(spark, sf_dir, duck):
    """Checks a query's rows against its SQL."""

    def check(query, sql):
        got, expected = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(expected.columns)
        columns = sorted(got.columns)
        a, b = rows_of(got, columns), rows_of(expected, columns)
        assert a == b, (columns, list((a - b).items())[:3], list((b - a).items())[:3])

    return check
