import os
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MONDAY = date(2020, 1, 6)


def weeks(n, start=MONDAY):
    return [start + timedelta(weeks=i) for i in range(n)]


def series_rows(values, depth=25.0, station="s"):
    return [(station, depth, d, i, v) for i, (d, v) in enumerate(zip(weeks(len(values)), values))]


@pytest.fixture
def o2_series(spark):
    """Build a weekly series of oxygen values, None for unknown."""

    def build(values, depth=25.0):
        return spark.createDataFrame(
            series_rows(values, depth),
            "station_id STRING, Depth_m DOUBLE, Date DATE, Time_Idx INT, O2_umol_L DOUBLE",
        )

    return build


def column(df, name, order="Date"):
    return [r[name] for r in df.orderBy(order).select(name, order).collect()]
