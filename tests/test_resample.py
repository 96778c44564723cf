import random
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tailseries.operators import resample
from tests.conftest import MONDAY, column, weeks

SCHEMA = "station_id STRING, Depth_m DOUBLE, Date TIMESTAMP, O2_umol_L DOUBLE"


def samples(spark, values, start=MONDAY, depth=25.0):
    rows = [
        ("s", depth, datetime.combine(d, datetime.min.time()), v)
        for d, v in zip(weeks(len(values), start), values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def prepared(df, **options):
    return resample.weekly_series(df, value_cols=["O2_umol_L"], **options)


def test_gap_at_the_limit_and_edges_are_filled(spark):
    values = column(prepared(samples(spark, [None, None, 64.0] + [None] * 8 + [1.0, 5.0, None])), "O2_umol_L")
    assert values[:3] == [64.0] * 3 and values[-3:] == [1.0, 5.0, 5.0]
    assert values[3:11] == pytest.approx([57.0, 50.0, 43.0, 36.0, 29.0, 22.0, 15.0, 8.0])


@pytest.mark.parametrize("missing", [9, 13, 30])
def test_longer_gap_is_filled_for_its_first_eight_weeks(spark, missing):
    values = column(prepared(samples(spark, [0.0] + [None] * missing + [missing + 1.0])), "O2_umol_L")
    assert values[:9] == pytest.approx(list(range(9)))
    assert values[9:-1] == [None] * (missing - 8) and values[-1] == missing + 1


def test_time_index_and_month(spark):
    rows = prepared(samples(spark, [10.0, 11.0, 12.0])).orderBy("Date").collect()
    assert [r.Time_Idx for r in rows] == [0, 1, 2]
    assert rows[0].month_sin == pytest.approx(np.sin(2 * np.pi / 12))
    assert rows[0].month_cos == pytest.approx(np.cos(2 * np.pi / 12))


def test_week_runs_from_tuesday_to_monday(spark):
    rows = [
        ("s", 1.0, datetime(2020, 1, 6, 23), 1.0),
        ("s", 1.0, datetime(2020, 1, 7, 1), 2.0),
        ("s", 1.0, datetime(2020, 1, 13, 12), 4.0),
    ]
    means = resample.weekly_mean(spark.createDataFrame(rows, SCHEMA), value_cols=["O2_umol_L"])
    got = {r.Date: r.O2_umol_L for r in means.collect()}
    assert got == {date(2020, 1, 6): 1.0, date(2020, 1, 13): 3.0}


def test_rows_after_the_last_monday_are_off_the_grid_but_keep_their_series(spark):
    rows = [
        ("s", 1.0, datetime(2020, 1, 6), 1.0),
        ("s", 1.0, datetime(2020, 1, 14), 5.0),
        ("late", 1.0, datetime(2020, 1, 15), 9.0),
    ]
    grid = resample.weekly_grid(spark.createDataFrame(rows, SCHEMA), value_cols=["O2_umol_L"])
    got = sorted((r.station_id, r.Date.day, r.O2_umol_L) for r in grid.collect() if r.O2_umol_L)
    assert got == [("s", 6, 1.0)]
    assert grid.where("station_id = 'late'").count() == 2


def test_start_within_a_day_still_meets_the_grid(spark):
    df = spark.createDataFrame([("s", 1.0, datetime(2020, 1, 6, 10), 3.0)], SCHEMA)
    assert column(prepared(df), "O2_umol_L") == [3.0]


def test_unknown_depth_belongs_to_no_series_but_counts_for_the_extent(spark):
    rows = [("s", None, datetime(2020, 1, 20), 7.0), ("s", 1.0, datetime(2020, 1, 6), 3.0)]
    df = prepared(spark.createDataFrame(rows, SCHEMA))
    assert column(df, "O2_umol_L") == [3.0, 3.0, 3.0]


def test_nan_counts_as_unknown_and_empty_columns_stay_empty(spark):
    df = samples(spark, [10.0, float("nan"), 30.0]).withColumn("E", F.lit(None).cast("double"))
    out = resample.weekly_series(df, value_cols=["O2_umol_L", "E"], observed_flags=True)
    assert column(out, "O2_umol_L") == [10.0, 20.0, 30.0]
    assert column(out, "O2_umol_L_observed") == [True, False, True]
    assert column(out, "E") == [None] * 3


def test_grid_per_group(spark):
    df = samples(spark, [1.0] * 3).unionByName(
        samples(spark, [2.0] * 2, start=date(2021, 1, 4)).withColumn("station_id", F.lit("t"))
    )
    own = prepared(df, extent_by=["station_id"])
    assert own.groupBy("station_id").count().orderBy("station_id").collect() == [("s", 3), ("t", 2)]


def test_depth_filter_reaches_the_scan(spark):
    sf = "/root/testdata/sf0.001/lineitem.parquet"
    df = spark.read.parquet(sf).select(
        F.col("l_suppkey").alias("station_id"),
        F.col("l_linenumber").alias("Depth_m"),
        F.col("l_shipdate").alias("Date"),
        F.col("l_quantity").alias("O2_umol_L"),
    )
    plan = (
        prepared(df).where("Depth_m = 4")._jdf.queryExecution().executedPlan().toString()
    )
    assert "EqualTo(l_linenumber,4)" in plan
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def pandas_series(values, limit=8):
    s = pd.Series(values, dtype="float64")
    s = s.interpolate(method="linear", limit=limit, limit_area="inside")
    return s.bfill(limit_area="outside").ffill(limit_area="outside")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_gaps_equal_an_independent_computation(spark, seed):
    rng = random.Random(seed)
    columns, rows, n = {}, [], 90
    for depth in (1.0, 5.0, 25.0):
        share = rng.choice([0.1, 0.3, 0.7])
        values = [rng.uniform(0, 300) if rng.random() < share else None for _ in range(n)]
        columns[depth] = values
        # Weeks without a value are either missing rows or rows with an unknown value.
        for d, v in zip(weeks(n), values):
            if v is not None or rng.random() < 0.5 or d in (weeks(n)[0], weeks(n)[-1]):
                rows.append(("s", depth, datetime.combine(d, datetime.min.time()), v))
    df = spark.createDataFrame(rows, SCHEMA)
    grid = resample.weekly_grid(df, value_cols=["O2_umol_L"])
    for out in (
        prepared(df),
        resample.interpolate_bounded(
            grid, keys=["station_id", "Depth_m"], value_cols=["O2_umol_L"]
        ),
    ):
        got = out.toPandas().sort_values(["Depth_m", "Date"])
        assert len(got) == 3 * n
        for depth, values in columns.items():
            mine = got[got.Depth_m == depth].O2_umol_L.to_numpy(dtype=float)
            np.testing.assert_allclose(mine, pandas_series(values).to_numpy(), rtol=1e-12)


def test_interpolation_stays_between_neighbours(spark):
    values = column(prepared(samples(spark, [5.0, None, None, 50.0, None, 20.0])), "O2_umol_L")
    assert 5.0 <= values[1] <= values[2] <= 50.0 and 20.0 <= values[4] <= 50.0
