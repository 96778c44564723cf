"""Registered queries on small tables of their own."""

from datetime import timedelta

import pytest

from driver_queries.catalog import QUERIES
from tests.conftest import weeks

N, LOW = 60, range(45, 53)


@pytest.fixture
def samples(spark, tmp_path):
    """Two series of sixty weeks; the cut after week 48 falls inside a run of low values."""
    first = timedelta(weeks=1040)
    rows = [
        (s, 1, d - first, 3.0 if i in LOW else 20.0 + i % 5, 100.0, 0.02, 0.03)
        for s in (1, 2)
        for i, d in enumerate(weeks(N))
    ]
    assert rows[LOW[0]][2].year == 2000
    spark.createDataFrame(
        rows,
        "l_suppkey BIGINT, l_linenumber INT, l_shipdate DATE, l_quantity DOUBLE, l_extendedprice DOUBLE,"
        " l_discount DOUBLE, l_tax DOUBLE",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["persistence", "risk_probability"])
def test_every_week_is_an_origin_for_every_horizon(spark, samples, name):
    rows = QUERIES[name](spark, samples).collect()
    assert len(rows) == 2 * sum(N - h for h in (1, 2, 3, 4))


def test_events_have_all_horizons_in_all_weeks(spark, samples):
    study = QUERIES["event_study"](spark, samples).collect()
    assert len(study) == 2 * len(LOW) * 4
    summary = QUERIES["event_summary"](spark, samples).collect()
    assert [r.n_weeks for r in summary] == [len(LOW)] * 8
