from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tailseries.functions import measures as M
from tailseries.operators import audit, episodes, features, labels
from tailseries.plans.prepare import labelled_table, prepare_weekly
from tests.conftest import column, weeks


@pytest.fixture
def two_depths(spark):
    """Six weeks of a surface and a bottom series whose values are easy to work out by hand."""
    oxygen = [140.0, 92.0, 131.0, 131.0, 57.0, 20.0]
    rows = []
    for i, d in enumerate(weeks(6)):
        rows.append(("p", 1.0, d, 30.0 - 2 * i, 7.0 * (40 + i), 0.5 * i, 2.0 + 3 * i, 45.0))
        rows.append(("p", 25.0, d, float(i * i), oxygen[i], float(2**i), 2.0 + 3 * i, 45.0))
    return spark.createDataFrame(
        rows,
        "station_id STRING, Depth_m DOUBLE, Date DATE, Temp_C DOUBLE, O2_umol_L DOUBLE, "
        "Chl_a DOUBLE, Wind_Speed_ms DOUBLE, Wind_Dir_deg DOUBLE",
    )


def test_surface_values_both_ways(two_depths):
    target = labels.select_depth(two_depths)
    joined = features.add_surface_values(target, two_depths)
    spread = features.spread_surface_values(two_depths).where("Depth_m = 25")
    for df in (joined, spread):
        assert column(df, "Surface_Temp_C") == [30.0, 28.0, 26.0, 24.0, 22.0, 20.0]
        assert column(df, "Surface_O2_umol_L") == [280.0, 287.0, 294.0, 301.0, 308.0, 315.0]


def test_surface_missing_gives_null(two_depths):
    third = weeks(3)[2]
    only = two_depths.where((F.col("Depth_m") == 25) | (F.col("Date") == F.lit(third)))
    expected = [None, None, 26.0, None, None, None]
    assert column(features.add_surface_values(labels.select_depth(only), only), "Surface_Temp_C") == expected
    spread = features.spread_surface_values(only).where("Depth_m = 25")
    assert column(spread, "Surface_Temp_C") == expected


def test_composition_holds_all_features(two_depths):
    a = features.engineer_features(labels.select_depth(two_depths), two_depths)
    b = features.engineer_features_at(two_depths)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert column(a, "Vertical_Temp_Grad") == [30.0, 27.0, 22.0, 15.0, 6.0, -5.0]
    assert column(a, "Vertical_O2_Grad") == [140.0, 195.0, 163.0, 170.0, 251.0, 295.0]
    assert column(a, "O2_Derivative_1W") == [None, -48.0, 39.0, 0.0, -74.0, -37.0]
    assert column(a, "Wind_Mixing_Energy") == [4.0, 25.0, 64.0, 121.0, 196.0, 289.0]
    assert column(a, "Wind_Dir_deg") == [45.0] * 6
    for k in (1, 2, 3, 4):
        assert column(a, f"Chl_a_lag_{k}W") == [None] * k + [float(2**i) for i in range(6 - k)]
    plain = features.engineer_features_at(two_depths, include_change=False)
    assert "O2_Derivative_1W" not in plain.columns and "Chl_a_lag_2W" in plain.columns


def test_rolling_mean(two_depths):
    df = features.add_rolling_mean(labels.select_depth(two_depths), column="Chl_a", weeks=3)
    assert column(df, "Chl_a_mean_3W") == pytest.approx([1.0, 1.5, 7 / 3, 14 / 3, 28 / 3, 56 / 3])


#: On, just under and far under each threshold.
LEVELS = [80.0, 79.5, 60.0, 59.75, 30.0, 29.0, 0.0, None]


def test_labels_are_strict_at_the_thresholds(o2_series):
    df = labels.label_risk(o2_series(LEVELS))
    assert column(df, "sample_weight") == [1.0, 3.0, 3.0, 6.0, 6.0, 12.0, 12.0, None]
    assert column(df, "oxygen_deficit") == [0.0, 0.0, 0.0, 0.25, 30.0, 31.0, 60.0, None]
    tiers = ["normoxic", "watch", "watch", "hypoxic", "hypoxic", "severe", "severe", None]
    assert column(labels.add_tier(df), "tier") == tiers
    assert column(labels.with_extreme_weights(df), "sample_weight") == [1.0] * 3 + [100.0] * 4 + [1.0]
    assert column(labels.with_uniform_weights(df), "sample_weight") == [1.0] * 8


def test_target_depth_only(two_depths):
    assert {r.Depth_m for r in labels.select_depth(two_depths).collect()} == {25.0}


def test_imbalance_counts_known_weeks(o2_series):
    row = labels.imbalance_report(o2_series(LEVELS)).first()
    assert (row.watch, row.hypoxic, row.severe) == pytest.approx((6 / 7, 4 / 7, 2 / 7))


def test_completeness_in_one_pass(o2_series):
    df = o2_series([90.0, None, 45.0, None])
    report = labels.completeness_report(df).first()
    assert (report.rows_before, report.rows_after, report.rows_dropped) == (4, 2, 2)
    assert report.dropped_pct == 50.0 and report.null_O2_umol_L == 2 and report.null_Date == 0
    assert labels.drop_incomplete(df).count() == 2


def test_episodes_end_at_the_threshold_and_at_unknown_weeks(o2_series):
    values = [59.0, 61.0, 12.0, None, 33.0, 58.0, 60.0, 8.0, 9.0, 8.0, 7.5]
    found = episodes.find_episodes(o2_series(values), with_id=True)
    at = weeks(len(values))
    rows = found.orderBy("start_date").collect()
    assert [(r.episode_id, r.start_date, r.end_date, r.duration_weeks, r.min_o2) for r in rows] == [
        (1, at[0], at[0], 1, 59.0),
        (2, at[2], at[2], 1, 12.0),
        (3, at[4], at[5], 2, 33.0),
        (4, at[7], at[10], 4, 7.5),
    ]
    stats = episodes.episode_statistics(found).first()
    assert (stats.n_episodes, stats.longest_weeks) == (4, 4)
    assert episodes.find_episodes(o2_series([None, 75.0])).count() == 0


def test_weeks_of_episodes_are_the_weeks_below(o2_series):
    values = [float((i * 37) % 120) for i in range(60)]
    total = episodes.find_episodes(o2_series(values)).agg(F.sum("duration_weeks")).first()[0]
    assert total == sum(v < 60 for v in values)


def test_held_out_events(o2_series):
    spans = {3: 1, 17: 7, 40: 2, 57: 3}
    low = {i for start, n in spans.items() for i in range(start, start + n)}
    df = o2_series([25.0 + i % 3 if i in low else 66.0 + i for i in range(64)])

    def starts(**options):
        return sorted(r.start_date for r in episodes.held_out_events(df, **options).collect())

    at = weeks(64)
    assert starts() == [at[17], at[40], at[57]]
    assert starts(min_weeks=3) == [at[17], at[57]]
    assert starts(min_weeks=1, from_date=at[18]) == [at[40], at[57]]
    assert starts(min_weeks=8) == []


def test_episodes_take_one_shuffle(o2_series):
    # Whole-number depths: Spark normalises floating keys and then does not see that the
    # windows and the grouping share a partitioning.
    df = o2_series([40.0, 90.0]).withColumn("Depth_m", F.col("Depth_m").cast("int"))
    plan = episodes.find_episodes(df)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


def test_weight_check_and_class_counts(o2_series):
    df = labels.add_tier_weight(o2_series([70.0, 75.0, 95.0, 50.0, 25.0, 55.0, None]))
    row = audit.weight_check(df).first()
    assert row.weight_present and (row.n_below, row.n_not_below) == (3, 4)
    assert (row.mean_weight_below, row.mean_weight_not_below) == pytest.approx((8.0, 7 / 3))
    assert row.weight_ratio == pytest.approx(24 / 7)
    counts = audit.class_counts(df).first()
    assert (counts.n_below, counts.n_not_below) == (3, 4)
    below = df.where("O2_umol_L < 60")
    assert audit.weight_check(below).first().weight_ratio is None
    assert audit.weight_check(below, empty_ratio_as_zero=True).first().weight_ratio == 0.0
    unweighted = df.withColumn("sample_weight", F.lit(None).cast("double"))
    assert not audit.weight_check(unweighted).first().weight_present


def test_sample_skewness(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "x DOUBLE")
    assert df.agg(audit.sample_skewness(F.col("x"))).first()[0] == pytest.approx(1.763632614803888)
    assert df.limit(2).agg(audit.sample_skewness(F.col("x"))).first()[0] is None


def test_risk_from_quantiles(spark):
    df = spark.createDataFrame([(50.0, 70.0, 90.0), (60.0, 60.0, 60.0)], "a DOUBLE, b DOUBLE, c DOUBLE")

    def risk(t):
        return [r[0] for r in df.select(M.crossing_probability(F.col("a"), F.col("b"), F.col("c"), t)).collect()]

    assert risk(60.0) == [pytest.approx(0.3), 0.5]
    assert risk(40.0)[0] == 0.05 and risk(95.0)[0] == 0.95
    assert risk(80.0)[0] == pytest.approx(0.7)


def test_softplus_inverts(spark):
    df = spark.createDataFrame([(0.5,), (20.0,), (500.0,)], "y DOUBLE")
    back = [r[0] for r in df.select(M.softplus(M.softplus_inverse(F.col("y")))).collect()]
    assert back == pytest.approx([0.5, 20.0, 500.0])


def test_from_samples_to_labelled_rows(spark):
    rows = [
        ("s", depth, datetime.combine(d, datetime.min.time()), 20.0 + 10 * i, 5.0, 1.0, 3.0)
        for depth in (1.0, 5.0, 25.0)
        for i, d in enumerate(weeks(10))
    ]
    observed = spark.createDataFrame(
        rows,
        "station_id STRING, Depth_m DOUBLE, Date TIMESTAMP, O2_umol_L DOUBLE, Temp_C DOUBLE, "
        "Chl_a DOUBLE, Wind_Speed_ms DOUBLE",
    )
    weekly = prepare_weekly(observed, depths=[1.0, 25.0])
    out = labelled_table(weekly)
    # Four rows go to the longest lag; they are dropped after all features exist.
    assert column(out, "Time_Idx") == list(range(4, 10))
    assert column(out, "sample_weight") == [3.0, 3.0, 1.0, 1.0, 1.0, 1.0]
    assert {r.Depth_m for r in out.select("Depth_m").distinct().collect()} == {25.0}
