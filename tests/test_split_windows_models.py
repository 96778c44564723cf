import math
import random

import pytest
from pyspark.sql import functions as F

from tailseries import config as C
from tailseries.models import experiments as X
from tailseries.models.forecast import Forecaster, fit_forecaster, model_frame, score_scenarios
from tailseries.operators import audit, episodes, evaluate, labels, split, windows
from tailseries.plans.train import train
from tailseries.sources import records
from tests.conftest import column, weeks


@pytest.fixture
def many_series(spark):
    """Three series of 50 weeks with weights and one driver."""
    rng = random.Random(5)
    rows = []
    for depth in (1.0, 5.0, 25.0):
        level = 100.0
        for i, d in enumerate(weeks(50)):
            driver = rng.uniform(-1, 1)
            level = max(5.0, min(200.0, level + 30 * driver))
            rows.append(("s", depth, d, i, level, driver))
    df = spark.createDataFrame(
        rows,
        "station_id STRING, Depth_m DOUBLE, Date DATE, Time_Idx INT, O2_umol_L DOUBLE, driver DOUBLE",
    )
    return labels.add_tier_weight(df)


def test_split_is_chronological(o2_series):
    train_df, val_df = split.split_frames(split.chronological_split(o2_series([1.0] * 100)))
    assert train_df.count() == 80 and val_df.count() == 20
    assert column(train_df, "Date")[-1] == weeks(100)[79]
    assert column(val_df, "Date")[0] == weeks(100)[80]


def test_split_keeps_order_and_does_not_leak(o2_series):
    train_df, val_df = split.split_frames(split.chronological_split(o2_series([1.0] * 50), ratio=0.7))
    assert column(train_df, "Time_Idx") == list(range(35))
    assert column(val_df, "Time_Idx") == list(range(35, 50))


@pytest.mark.parametrize("ratio", [0.29, 0.7, 0.8, 0.0, 1.0])
def test_split_is_exact_when_the_cut_falls_inside_a_day(many_series, ratio):
    out = split.chronological_split(many_series, ratio=ratio).collect()
    train_rows = [r for r in out if r.split == "train"]
    assert len(out) == 150 and len(train_rows) == int(150 * ratio)
    rest = [r.Date for r in out if r.split == "validation"]
    if train_rows and rest:
        assert max(r.Date for r in train_rows) <= min(rest)


def test_split_needs_dates(many_series):
    with pytest.raises(TypeError):
        split.chronological_split(many_series.withColumn("Date", F.col("Date").cast("timestamp")))


def test_split_per_series_and_profile(many_series):
    out = split.split_per_series(many_series)
    sizes = out.where("split = 'train'").groupBy("Depth_m").count().collect()
    assert {r["count"] for r in sizes} == {40}
    profile = {r.split: r for r in audit.dataset_profile(out).collect()}
    assert {k: v.n_rows for k, v in profile.items()} == {"train": 120, "validation": 30, "total": 150}
    assert profile["validation"].first_date == weeks(50)[40]


def test_windows_follow_the_time_index(spark, o2_series):
    df = labels.add_tier_weight(o2_series([100.0] * 9)).where("Time_Idx NOT IN (5, 6)")
    out = {r.Time_Idx: r for r in windows.encoder_decoder_windows(df).collect()}
    at4 = out[4]
    assert [s.Time_Idx for s in at4.encoder] == [0, 1, 2, 3, 4]
    assert [s.Time_Idx for s in at4.decoder] == [7, 8]
    assert at4.encoder_length == 5 and at4.relative_index == [-4, -3, -2, -1, 0, 3, 4]
    assert min(out) == 3 and 8 not in out
    assert "sample_weight" in at4.decoder[0].asDict() and "sample_weight" not in at4.encoder[0].asDict()


def test_last_window_has_a_full_decoder(many_series):
    w = windows.encoder_decoder_windows(many_series)
    assert {r.Time_Idx for r in windows.last_window(w).collect()} == {45}


def test_windows_stay_inside_the_split(many_series):
    parts = split.split_per_series(many_series)
    w = windows.encoder_decoder_windows(parts, split_col="split")
    steps = windows.window_steps(w, keys=["station_id", "Depth_m", "split"])
    at = steps.withColumn("t", F.col("origin") + F.col("offset"))
    assert at.where("split = 'train'").agg(F.max("t")).first()[0] == 39
    assert at.where("split = 'validation'").agg(F.min("t")).first()[0] == 40


def test_steps_carry_columns_of_their_window(many_series):
    w = windows.encoder_decoder_windows(many_series)
    steps = windows.window_steps(w, carry=["encoder_length"]).collect()
    sizes = {(r.Depth_m, r.Time_Idx): (len(r.encoder), len(r.decoder)) for r in w.collect()}
    assert all(s.encoder_length == sizes[s.Depth_m, s.origin][0] for s in steps)
    assert len(steps) == sum(a + b for a, b in sizes.values())


def test_validation_is_scaled_by_training_rows(many_series):
    train_df, val_df = split.split_frames(split.split_per_series(many_series))
    scaling = windows.fit_scaling(train_df)
    own = windows.apply_scaling(train_df, scaling)
    row = own.groupBy("Depth_m").agg(F.avg("O2_umol_L_scaled"), F.stddev("O2_umol_L_scaled")).first()
    assert row[1] == pytest.approx(0.0, abs=1e-9) and row[2] == pytest.approx(1.0)
    scaled = windows.apply_scaling(val_df, scaling)
    back = windows.unscale(scaled, column="O2_umol_L_scaled", name="back")
    assert back.where("abs(back - O2_umol_L) > 1e-6").count() == 0


def brute_auc(rows):
    pos = [r.predicted for r in rows if r.actual < 60]
    neg = [r.predicted for r in rows if r.actual >= 60]
    won = sum((p < n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_auc_equals_counting_all_pairs(spark, partitions):
    rng = random.Random(partitions)
    data = [(rng.choice("ab"), rng.uniform(0, 120), float(rng.randrange(0, 120, 7))) for _ in range(200)]
    df = spark.createDataFrame(data, "g STRING, actual DOUBLE, predicted DOUBLE")
    rows = df.collect()
    whole = evaluate.roc_auc(df, partitions=partitions).first()
    assert whole.roc_auc == pytest.approx(brute_auc(rows))
    for r in evaluate.roc_auc(df, by=["g"], partitions=partitions).collect():
        assert r.roc_auc == pytest.approx(brute_auc([x for x in rows if x.g == r.g]))
    assert evaluate.roc_auc(df.where("actual < 60")).first().roc_auc is None


def test_persistence_and_scores(o2_series):
    df = labels.add_tier_weight(o2_series([100.0, None, 50.0, 20.0]))
    rows = evaluate.persistence(df, horizons=[1, 2]).orderBy("origin", "horizon").collect()
    got = [(r.horizon, r.predicted, r.actual, r.sample_weight) for r in rows]
    assert got == [(2, 100.0, 50.0, 6.0), (1, 100.0, 50.0, 6.0), (2, 100.0, 20.0, 12.0), (1, 50.0, 20.0, 12.0)]
    scores = evaluate.weighted_scores(evaluate.persistence(df, horizons=[1, 2])).first()
    assert scores.weighted_rmse == pytest.approx(
        math.sqrt((6 * 2500 + 6 * 2500 + 12 * 6400 + 12 * 900) / 36)
    )


def test_sweep_pinball_and_expectations(spark):
    df = spark.createDataFrame(
        [(20.0, 20.0, 1.0), (50.0, 90.0, 3.0), (90.0, 50.0, 1.0), (90.0, 90.0, 1.0)],
        "actual DOUBLE, predicted DOUBLE, sample_weight DOUBLE",
    )
    at60 = evaluate.threshold_sweep(df, thresholds=[60.0]).first()
    assert (at60.tp, at60.fp, at60.fn, at60.tn) == (1, 1, 1, 1)
    assert at60.precision == at60.recall == at60.f1 == at60.accuracy == 0.5
    loss = evaluate.pinball_scores(df, quantile_cols={0.1: "predicted"}).first()
    assert loss.pinball_10 == pytest.approx((3 * 0.9 * 40 + 0.1 * 40) / 6)
    check = evaluate.expectation_check(spark.createDataFrame([(0.5, 0.8)], "f1 DOUBLE, roc_auc DOUBLE"))
    assert {r.metric: r.verdict for r in check.collect()} == {"f1": "above", "roc_auc": "within"}
    horizons = spark.createDataFrame([(1, 0.9), (2, 0.75), (3, 0.6), (4, 0.8)], "horizon INT, roc_auc DOUBLE")
    assert evaluate.largest_reliable_horizon(horizons).first()[0] == 2


def test_event_study_covers_every_week_of_an_event(o2_series):
    values = [100.0] * 20
    values[10:14] = [40.0] * 4
    df = labels.add_tier_weight(o2_series(values))
    events = episodes.held_out_events(df)
    study = evaluate.event_study(events, evaluate.persistence(df, horizons=[1, 2]))
    assert study.count() == 8
    summary = {r.horizon: r for r in evaluate.event_summary(study).collect()}
    assert summary[1].n_weeks == 4 and summary[1].mae_predicted == 15.0


def test_models_experiments_and_records(spark, many_series, tmp_path):
    parts = split.chronological_split(many_series)
    frame = model_frame(
        parts, features=["driver"], keys=[*C.SERIES_KEYS, "split"], encoder_length=4, decoder_length=2
    )
    model = fit_forecaster(frame.where(F.col("split") == "train"))
    out = model.predict(frame.where(F.col("split") == "validation"))
    assert out.where("p10 > p90 OR predicted IS NULL").count() == 0
    assert {r.horizon for r in out.select("horizon").distinct().collect()} == {1, 2}
    scenarios = score_scenarios(model, frame, {"as_is": {}, "low": {"driver": -1.0}})
    means = {r.scenario: r.m for r in scenarios.groupBy("scenario").agg(F.avg("predicted").alias("m")).collect()}
    assert means["low"] < means["as_is"]

    result = X.weight_experiment(parts, features=["driver"]).collect()
    assert {r.weights for r in result} == {"extreme", "uniform"}
    assert all(r.passed == (r.difference_pct > 5) for r in result)

    path = str(tmp_path / "run")
    run = train(many_series, path=path, parameters={"decoder_length": 2.0})
    assert run.features == ["driver"] and run.metrics.count() == 2
    again = Forecaster.load(spark, f"{path}/model")
    assert again.models == run.model.models and again.offsets == run.model.offsets
    manifest = records.read_manifest(spark, f"{path}/manifest").first()
    assert manifest.weights.tier_weights["severe"] == 12.0
    assert {d.split: d.n_rows for d in manifest.dataset}["train"] == 120


def test_forward_selection_stops_when_nothing_helps(many_series):
    gain = {"a": 3.0, "b": 1.0, "c": -1.0}
    selected, steps = X.forward_selection(
        many_series,
        candidates=["a", "b", "c"],
        base=["x"],
        metric=lambda f, df, target: 10.0 - sum(gain.get(c, 0.0) for c in f),
    )
    assert selected == ["x", "a", "b"] and [s for _, s in steps] == [10.0, 7.0, 6.0]


@pytest.mark.parametrize("partitions", [1, 5])
def test_residual_quantiles_follow_fractional_weights(spark, partitions):
    from tailseries.models.forecast import residual_quantiles

    rows = [(1, float(i), 0.0, 0.4) for i in range(90)] + [(1, 90.0 + i, 0.0, 3.6) for i in range(10)]
    rows += [(2, 5.0, 1.0, 2.5), (2, 7.0, 1.0, 0.0), (2, None, 1.0, 1.0), (2, 5.0, 1.0, None)]
    table = spark.createDataFrame(rows, f"horizon INT, actual DOUBLE, predicted DOUBLE, {C.WEIGHT} DOUBLE")
    got = residual_quantiles(table, quantiles=(0.1, 0.5, 0.9), partitions=partitions).collect()
    assert {(r.horizon, r.q): r.offset for r in got} == {
        (1, 0): 17.0, (1, 1): 89.0, (1, 2): 97.0, (2, 0): 4.0, (2, 1): 4.0, (2, 2): 4.0
    }
