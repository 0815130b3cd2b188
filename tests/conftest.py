"""One Spark session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TIDELEX_TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidelex.session import session

    own = tmp_path_factory.mktemp("spark")
    made = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.local.dir": str(own),
        "spark.sql.warehouse.dir": str(own / "warehouse"), "spark.checkpoint.dir": str(own / "shared"), "spark.driver.memory": "4g",
    })
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else value


def same_as_sql(frame, sql: str, sf_dir: str) -> None:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((str(plain(r)) for r in found.fetchall()))
    got = sorted(str(plain(tuple(r))) for r in frame.select(*names).collect())
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []


@pytest.fixture(scope="session")
def check_sql():
    return same_as_sql


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def middle():
    return f"{DATA}/sf0.01"
