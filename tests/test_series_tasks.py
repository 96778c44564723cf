from pyspark.sql import functions as F

from tailseries.operators import episodes, evaluate, resample


def _samples(spark, series, weeks=10):
    return spark.range(series * weeks).select(
        (F.col("id") % series).alias("station_id"),
        (F.col("id") % series % 3).cast("int").alias("Depth_m"),
        F.expr(f"date_add(DATE '2020-01-06', cast(7 * floor(id / {series}) as int))").alias("Date"),
        F.col("id").cast("double").alias("O2_umol_L"),
    )


def test_tasks_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = (resample.series_tasks(_samples(spark, n), rows_per_task=100) for n in (20, 400))
    assert few == cores and 36 <= many <= 44
    assert resample.series_tasks(_samples(spark, 0)) == cores


def _tasks(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_series_are_spread_over_as_many_tasks_as_given(spark):
    df = _samples(spark, 200)
    want = sorted(map(tuple, resample.weekly_series(df, value_cols=["O2_umol_L"]).collect()))
    for places in ([], ["station_id"]):
        rows = resample.weekly_series(df, value_cols=["O2_umol_L"], tasks=13, cluster_by=places)
        assert _tasks(rows) == 13
        assert sorted(map(tuple, rows.collect())) == want
    grid = resample.weekly_grid(df, value_cols=["O2_umol_L"], tasks=13)
    assert _tasks(resample.interpolate_bounded(grid, keys=["station_id", "Depth_m"], value_cols=["O2_umol_L"])) == 13


def _shuffled_by(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_forecasts_are_not_shuffled_to_meet_the_events_of_their_series(spark):
    low = F.when(F.col("id") % 3 < 2, 20.0).otherwise(200.0)
    samples = _samples(spark, 20).withColumn("id", F.floor("O2_umol_L")).withColumn("O2_umol_L", low)
    extent = resample.time_extent(samples)
    weeks = resample.weekly_mean(samples, value_cols=["O2_umol_L"])
    rows = resample.unfold_weeks(weeks, value_cols=["O2_umol_L"], extent=extent, tasks=13)
    rows = rows.withColumn("sample_weight", F.lit(1.0))
    study = evaluate.event_study(episodes.find_episodes(rows), evaluate.persistence(rows, horizons=[1, 2]))
    # Once by series and week for the means and once by series, for events and for forecasts.
    assert len(_shuffled_by(study)) == 4
    events, forecasts = episodes.find_episodes(rows).collect(), evaluate.persistence(rows, horizons=[1, 2]).collect()
    want = {
        (e.station_id, e.start_date, f.Date, f.horizon)
        for e in events
        for f in forecasts
        if f.station_id == e.station_id and e.start_date <= f.Date <= e.end_date
    }
    assert want and {(r.station_id, r.start_date, r.Date, r.horizon) for r in study.collect()} == want


def test_a_week_of_several_events_counts_for_each(spark):
    events = spark.createDataFrame(
        [
            ("s", 1, "2020-01-06", "2020-01-20"),
            ("s", 1, "2020-01-20", "2020-01-27"),
            ("s", 1, "2020-01-20", "2020-01-27"),
            (None, 1, "2020-01-06", "2020-01-20"),
        ],
        "station_id STRING, Depth_m INT, start STRING, end STRING",
    ).selectExpr("station_id", "Depth_m", "date(start) AS start_date", "date(end) AS end_date")
    said = spark.createDataFrame(
        [
            ("s", 1, "2020-01-20"),
            ("s", 1, "2020-01-20"),
            ("s", 1, "2020-01-21"),
            ("s", 1, None),
            (None, 1, "2020-01-20"),
            ("s", None, "2020-01-20"),
        ],
        "station_id STRING, Depth_m INT, day STRING",
    ).selectExpr("station_id", "Depth_m", "date(day) AS Date", "date(day) AS origin", "1 AS horizon")
    said = said.withColumns({"actual": F.lit(1.0), "predicted": F.lit(2.0)})
    study = evaluate.event_study(events, said).collect()
    assert sorted(str(r.start_date) for r in study) == ["2020-01-06"] * 2 + ["2020-01-20"] * 4
