import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("cairn-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "/tmp/cairn-tests-checkpoint")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def compare(spark, name, queries, sql, folder=DATA):
    """Rows of the Spark query against those of its SQL, whatever their order."""
    from collections import Counter

    import duckdb

    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    found = con.execute(sql[name])
    columns = sorted(d[0] for d in found.description)
    names = [d[0] for d in found.description]

    def plain(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    expected = Counter(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    df = queries[name](spark, folder)
    assert sorted(df.columns) == columns
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])
