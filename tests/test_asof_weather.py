import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from tailseries import config as C
from tailseries.operators import weather
from tailseries.operators.asof import asof_nearest


def ts(day, **kw):
    return datetime(2020, 1, day) + timedelta(**kw)


def run(spark, left, right, **options):
    l = spark.createDataFrame([(t,) for t in left], "Date TIMESTAMP")
    r = spark.createDataFrame(
        [(t, v, i) for i, (t, v) in enumerate(right)], "Date TIMESTAMP, v DOUBLE, seq INT"
    )
    out = asof_nearest(l, r, value_cols=["v"], sequence_cols=["seq"], **options)
    return [row.v for row in out.orderBy("Date").collect()]


def test_nearest_with_ties_and_copies(spark):
    right = [(ts(1), 1.0), (ts(1), 11.0), (ts(3), 2.0), (ts(13), 3.0)]
    assert run(spark, [ts(2), ts(10), ts(20)], right) == [11.0, 3.0, None]
    assert run(spark, [ts(2)], [(ts(3), 2.0), (ts(3), 22.0)]) == [2.0]


def test_null_day_within_reach_wins_over_a_farther_filled_day(spark):
    assert run(spark, [ts(2)], [(ts(1), 5.0), (ts(2), None)]) == [None]


def test_left_without_time_is_kept_unmatched(spark):
    assert run(spark, [None, ts(1)], [(ts(1), 5.0)]) == [None, 5.0]


@pytest.mark.parametrize("bucket", [timedelta(minutes=7), timedelta(hours=5), timedelta(days=9)])
def test_random_keys_equal_an_independent_computation(spark, bucket):
    rng = random.Random(bucket.seconds)
    base = datetime(2020, 1, 1)

    def moment():
        # Coarse times give ties and copies, fine ones sub-second distances.
        coarse = rng.random() < 0.5
        return base + (
            timedelta(hours=rng.randrange(0, 24 * 12, 3))
            if coarse
            else timedelta(seconds=rng.randrange(12 * 86400), microseconds=rng.randrange(10**6))
        )

    left = pd.DataFrame([(rng.choice("ab"), moment()) for _ in range(150)], columns=["k", "Date"])
    right = pd.DataFrame(
        [(rng.choice("abc"), moment(), rng.choice([None, rng.random()])) for _ in range(80)],
        columns=["k", "Date", "v"],
    )
    right = right.assign(v=right.v.astype("float64"), seq=range(len(right)))
    tolerance = timedelta(hours=9)
    want = pd.merge_asof(
        left.sort_values("Date", kind="stable").assign(Date=lambda d: d.Date.astype("datetime64[ns]")),
        right.sort_values("Date", kind="stable").assign(
            Date=lambda d: d.Date.astype("datetime64[ns]")
        ),
        on="Date",
        by="k",
        direction="nearest",
        tolerance=pd.Timedelta(tolerance),
    )
    r = spark.createDataFrame(
        [(k, d.to_pydatetime(), None if pd.isna(v) else v, s) for k, d, v, s in right.itertuples(index=False)],
        "k STRING, Date TIMESTAMP, v DOUBLE, seq INT",
    )
    l = spark.createDataFrame(
        [(k, d.to_pydatetime()) for k, d in left.itertuples(index=False)], "k STRING, Date TIMESTAMP"
    )
    out = asof_nearest(
        l, r, value_cols=["v", "seq"], by=["k"], sequence_cols=["seq"], tolerance=tolerance, bucket=bucket
    ).toPandas()
    order = ["k", "Date", "seq"]
    got = out.sort_values(order, ignore_index=True)[[*order, "v"]].astype({"seq": "float64"})
    want = want.sort_values(order, ignore_index=True)[[*order, "v"]].astype({"seq": "float64"})
    got["Date"] = got.Date.astype("datetime64[ns]")
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_daily_weather(spark):
    rows = [
        ("w", ts(1, hours=1), "wind_speed", 2.0),
        ("w", ts(1, hours=1), "wind_speed", 4.0),
        ("w", ts(1, hours=1), "wind_direction", 350.0),
        ("w", ts(1, hours=2), "wind_direction", 10.0),
        ("w", ts(1, hours=2), "wind_speed", 5.0),
        ("w", ts(3, hours=5), "wind_speed", 1.0),
    ]
    readings = spark.createDataFrame(
        rows, "station_id STRING, date TIMESTAMP, parameter STRING, value DOUBLE"
    )
    days = weather.weather_daily(readings).orderBy("Date").collect()
    assert [d.Date.day for d in days] == [1, 2, 3]
    # Copies of an hour are averaged first; direction is an arithmetic mean.
    assert days[0].Wind_Speed_ms == 4.0 and days[0].Wind_Dir_deg == 180.0
    assert days[0].Wind_U == pytest.approx(0.0, abs=1e-12) and days[0].Wind_V == pytest.approx(4.0)
    assert days[1].Wind_Speed_ms is None and days[2].Wind_Dir_deg is None
    assert days[0].Air_Temp_C is None and days[2].Wind_U is None


def test_weather_of_stations_needs_a_key(spark):
    from tailseries.plans.prepare import join_weather

    day = datetime(2020, 1, 1)
    ocean = spark.createDataFrame([("a", day), ("b", day)], "station_id STRING, Date TIMESTAMP")
    weather = spark.createDataFrame([("a", day, 1.0), ("b", day, 9.0)], f"station_id STRING, Date TIMESTAMP, {C.WEATHER_VALUES[0]} DOUBLE")
    with pytest.raises(ValueError, match="stations"):
        join_weather(ocean, weather)
    got = join_weather(ocean, weather, by=["station_id"]).collect()
    assert {r.station_id: r[C.WEATHER_VALUES[0]] for r in got} == {"a": 1.0, "b": 9.0}


def test_station_map_gives_each_ocean_station_its_own_weather(spark):
    from tailseries.plans.prepare import join_weather

    ocean = spark.createDataFrame(
        [("o1", ts(5), 1), ("o2", ts(5), 2), ("o3", ts(5), 3), ("o4", ts(20), 4), (None, ts(5), 5)],
        "station_id STRING, Date TIMESTAMP, _served INT",
    ).withColumnRenamed("_served", "id")
    weather = spark.createDataFrame(
        [("w1", ts(4), 10.0), ("w2", ts(6), 20.0), ("w2", ts(5, hours=1), 25.0)],
        "station_id STRING, Date TIMESTAMP, Air_Temp_C DOUBLE",
    )
    served = spark.createDataFrame(
        [("o1", "w1"), ("o2", "w2"), ("o2", "w2"), ("o4", "w1"), ("o9", "w2")], "station_id STRING, weather_station STRING"
    )
    got = {r.id: r.Air_Temp_C for r in join_weather(ocean, weather, station_map=served).collect()}
    assert got == {1: 10.0, 2: 25.0, 3: None, 4: None, 5: None}
    assert join_weather(ocean, weather, station_map=served).columns == ["station_id", "Date", "id", "Air_Temp_C"]
    with pytest.raises(ValueError, match="station map"):
        join_weather(ocean, weather)
    double = served.union(spark.createDataFrame([("o1", "w2")], served.schema))
    with pytest.raises(ValueError, match="o1"):
        join_weather(ocean, weather, station_map=double)
