import tempfile

import pytest

from curveloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.local.dir": scratch,
        "spark.checkpoint.dir": f"{scratch}/checkpoints",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def skewed(spark):
    """Three curves, one of which holds almost every row, with ties in the first order column."""
    rows = []
    for curve, n in (("big", 900), ("mid", 40), ("one", 1)):
        for i in range(n):
            x = abs(2 * ((i * 37) % n) / max(1, n - 1) - 1)
            rows.append((curve, i // 3, i, x, float((i * 7919) % 101), None if i % 4 else float(i)))
    df = spark.createDataFrame(rows, "curve string, t int, id int, x double, y double, sparse double")
    return df.repartition(7)
