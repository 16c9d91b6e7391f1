import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def make_log(spark):
    """A log from (case, act, seconds[, resource]) in order."""

    def make(rows):
        places, out = {}, []
        for case, act, s, *res in rows:
            pos = places[case] = places.get(case, -1) + 1
            out.append((case, pos, act, res[0] if res else None, int(s * 1_000_000)))
        return spark.createDataFrame(out, "case_id long, pos long, act string, res string, us long")

    return make


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def same_rows(df, con, sql):
    """Both engines' rows, by columns in order of name."""
    order = sorted(df.columns)
    found = con.execute(sql)
    at = [[d[0] for d in found.description].index(c) for c in order]
    theirs = sorted((tuple(str(plain(r[i])) for i in at) for r in found.fetchall()))
    ours = sorted(tuple(str(plain(r[c])) for c in order) for r in df.collect())
    return ours, theirs
