import datetime as dt

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def day(n, start=dt.date(2020, 1, 1)):
    return start + dt.timedelta(days=n)


@pytest.fixture
def make_bars(spark):
    """Bars of one or more symbols from close lists, in shuffled order."""

    def make(**closes):
        rows = [(s, day(i), float(c), float(c) + 1, float(c) - 1, float(c), 100 + i) for s, cs in closes.items() for i, c in enumerate(cs) if c is not None]
        return spark.createDataFrame(rows[::-1], "symbol string, date date, open double, high double, low double, close double, volume long")

    return make
