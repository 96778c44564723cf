"""Scores that look at the tail: weighted error, threshold sweep, ROC-AUC, event study.

A prediction table holds one row per series, origin and horizon: ``origin`` and ``Date``
(the target week), ``horizon``, ``actual``, ``predicted`` and ``sample_weight``. All scores
are sums per group, so the rows are combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tailseries import config as C
from tailseries.functions.measures import below, crossing_probability, pinball

# Ranges in which a result counts as plausible.
EXPECTED_RANGES = {"f1": (0.2, 0.4), "roc_auc": (0.7, 0.85)}


def add_future(
    df: DataFrame,
    *,
    columns: Mapping[str, str],
    horizons: Sequence[int] = (1, 2, 3, 4),
    keys: Sequence[str] = C.SERIES_KEYS,
    index_col: str = C.TIME_INDEX,
) -> DataFrame:
    """Values that many steps later, as ``<name>_<h>`` next to each row.

    Steps are counted on the time index, so a missing week gives NULL and not the week after
    it. All horizons share one window.
    """
    series = W.partitionBy(*keys).orderBy(index_col)
    value = F.struct(*[F.col(c).alias(name) for c, name in columns.items()])
    ahead = {f"_h{h}": F.first(value).over(series.rangeBetween(h, h)) for h in horizons}
    flat = {f"{n}_{h}": F.col(f"_h{h}")[n] for h in horizons for n in columns.values()}
    return df.withColumns(ahead).withColumns(flat).drop(*ahead)


def unfold_horizons(
    df: DataFrame,
    *,
    columns: Sequence[str],
    keep: Sequence[str],
    horizons: Sequence[int],
    time_col: str = C.TIME,
) -> DataFrame:
    """Columns ``<name>_<h>`` to one row per horizon, with ``origin`` and the target week.

    Origins without a known target, the first of ``columns``, are left out.
    """
    steps = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.date_add(F.col(time_col), 7 * h).alias("_at"),
                *[F.col(f"{c}_{h}").alias(c) for c in columns],
            )
            for h in horizons
        ]
    )
    return (
        df.select(*keep, F.col(time_col).alias("origin"), F.inline(steps))
        .where(F.col(columns[0]).isNotNull())
        .withColumnRenamed("_at", time_col)
    )


def persistence(
    df: DataFrame,
    *,
    horizons: Sequence[int] = (1, 2, 3, 4),
    keys: Sequence[str] = C.SERIES_KEYS,
    index_col: str = C.TIME_INDEX,
    time_col: str = C.TIME,
    target: str = C.TARGET,
    weight: str = C.WEIGHT,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Baseline forecast: the last known value as of the origin."""
    upto = W.partitionBy(*keys).orderBy(index_col).rowsBetween(W.unboundedPreceding, 0)
    held = df.withColumn("predicted", F.last(target, ignorenulls=True).over(upto)).transform(
        add_future,
        columns={target: "actual", weight: C.WEIGHT},
        horizons=horizons,
        keys=keys,
        index_col=index_col,
    )
    keep = [*keys, *[c for c in carry if c not in keys], "predicted"]
    return unfold_horizons(
        held.where(F.col("predicted").isNotNull()),
        columns=["actual", C.WEIGHT],
        keep=keep,
        horizons=horizons,
        time_col=time_col,
    )


def _merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted moments of groups from those of their parts with one weight each.

    Parts hold ``_w`` (sum of weights), means ``_mx``, ``_my`` and mean squared deviations ``_vx``, ``_vy``, ``_c``. What lies
    between the parts is added around the group's own mean, so no square of a large mean is ever summed.
    """
    w = F.col("_w")
    means = parts.groupBy(*by).agg(
        F.sum("_w").alias("_all"),
        F.try_divide(F.sum(w * F.col("_mx")), F.sum("_w")).alias("_x"),
        F.try_divide(F.sum(w * F.col("_my")), F.sum("_w")).alias("_y"),
    )
    if by:
        names = [F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)]
        same = reduce(lambda p, q: p & q, [F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
        parts = parts.join(means.select(*names, "_all", "_x", "_y"), same)
    else:
        total = means.select(F.struct("_all", "_x", "_y").alias("t")).scalar()
        parts = parts.withColumn("_t", total).withColumns({c: F.col("_t")[c] for c in ("_all", "_x", "_y")})
    dx, dy = F.col("_mx") - F.col("_x"), F.col("_my") - F.col("_y")
    return parts.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.first("_all").alias("_all"),
        F.sum(w * (F.col("_vx") + dx * dx)).alias("_xx"),
        F.sum(w * (F.col("_vy") + dy * dy)).alias("_yy"),
        F.sum(w * (F.col("_c") + dx * dy)).alias("_xy"),
        F.sum("_ee").alias("_ee"),
        F.sum("_tail").alias("_tail"),
        F.sum("_low").alias("_low"),
    )


def weighted_scores(predictions: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Weighted correlation and RMSE, and the plain RMSE below the hypoxic threshold.

    Rows of equal weight are combined first into counts, means and centred co-moments, which Spark merges pairwise
    before and after the shuffle; groups are put together from these. Digits do not depend on how far values lie
    from zero. Weights are few (one per tier); as many as rows give the same result at the price of a row each.
    A row without forecast, observation or weight counts in ``n`` only. No spread, no correlation: NULL.
    """
    by = list(by)
    x, y = F.col("predicted").cast("double"), F.col("actual").cast("double")
    known = x.isNotNull() & y.isNotNull()
    error = (y - x) * (y - x)
    low = below(y, C.TIERS.hypoxic)
    parts = predictions.groupBy(*by, F.col(C.WEIGHT).cast("double").alias("_one")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(known).alias("_k"),
        F.avg(F.when(known, x)).alias("_mx"),
        F.avg(F.when(known, y)).alias("_my"),
        F.var_pop(F.when(known, x)).alias("_vx"),
        F.var_pop(F.when(known, y)).alias("_vy"),
        F.covar_pop(x, y).alias("_c"),
        F.avg(error).alias("_e"),
        F.sum(F.when(low, error)).alias("_tail"),
        F.count(F.when(low, error)).alias("_low"),
    )
    parts = parts.withColumn("_w", F.col("_one") * F.col("_k")).withColumn("_ee", F.col("_w") * F.col("_e"))
    sums = _merged(parts, by)
    spread = F.sqrt("_xx") * F.sqrt("_yy")
    return sums.select(
        *by,
        "n",
        F.when(spread > 0, F.col("_xy") / spread).alias("weighted_corr"),
        F.sqrt(F.try_divide("_ee", "_all")).alias("weighted_rmse"),
        F.sqrt(F.try_divide("_tail", "_low")).alias("tail_rmse"),
    )


def pinball_scores(
    predictions: DataFrame,
    *,
    quantile_cols: Mapping[float, str],
    by: Sequence[str] = (),
    actual: str = "actual",
    weight: str = C.WEIGHT,
) -> DataFrame:
    """Weighted quantile loss per quantile (``pinball_10`` and so on) and their mean."""
    w = F.col(weight)
    sums = predictions.groupBy(*by).agg(
        F.sum(w).alias("_w"),
        *[
            F.sum(w * pinball(F.col(actual), F.col(c), q)).alias(f"_q{i}")
            for i, (q, c) in enumerate(quantile_cols.items())
        ],
    )
    names = [f"pinball_{round(q * 100):02d}" for q in quantile_cols]
    losses = [F.try_divide(F.col(f"_q{i}"), F.col("_w")) for i in range(len(names))]
    total = sum(losses[1:], losses[0]) / F.lit(float(len(losses)))
    return sums.select(
        *by, *[loss.alias(n) for n, loss in zip(names, losses)], total.alias("pinball_mean")
    )


def threshold_sweep(
    predictions: DataFrame,
    *,
    thresholds: Sequence[float] = (30.0, 60.0, 80.0),
    by: Sequence[str] = (),
) -> DataFrame:
    """Read the forecast as a classifier ("below t") at every threshold.

    All thresholds are counted side by side in one aggregation and unfolded afterwards, so
    the rows are not repeated per threshold.
    """

    def counts(t: float) -> Column:
        said, was = below(F.col("predicted"), t), below(F.col("actual"), t)
        return F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if(said & was).alias("tp"),
            F.count_if(said & ~was).alias("fp"),
            F.count_if(~said & was).alias("fn"),
            F.count_if(~said & ~was).alias("tn"),
        )

    table = (
        predictions.groupBy(*by)
        .agg(F.array(*[counts(t) for t in thresholds]).alias("_rows"))
        .select(*by, F.inline("_rows"))
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return table.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def roc_auc(
    predictions: DataFrame,
    *,
    threshold: float = C.TIERS.hypoxic,
    by: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Exact area under the ROC curve for "actual below threshold", lower forecast = riskier.

    The area is the chance that a positive is ranked ahead of a negative, ties counting
    half. Equal forecasts are combined first. Pairs of forecasts in one range of values are
    counted inside that range, pairs across ranges from the totals of the ranges, so no task
    sees more than its range and any choice of ranges gives the same number.
    """
    positive = below(F.col("actual"), threshold)
    by = list(by)
    per_score = (
        predictions.where(F.col("predicted").isNotNull() & F.col("actual").isNotNull())
        .groupBy(*by, "predicted")
        .agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    )
    if partitions is None:
        partitions = int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = per_score.repartitionByRange(partitions, *by, "predicted").withColumn(
        "_range", F.spark_partition_id()
    )
    inside = W.partitionBy(*by, "_range").orderBy(F.desc("predicted"))
    higher = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    # In doubles: products of counts outgrow a long.
    won = F.col("p").cast("double") * (higher.cast("double") + 0.5 * F.col("n"))
    per_range = (
        ranged.withColumn("_won", won)
        .groupBy(*by, "_range")
        .agg(
            F.sum("_won").alias("_won"),
            F.sum("p").alias("p"),
            F.sum("n").alias("n"),
            F.max("predicted").alias("_top"),
        )
    )
    # One row per group and range from here on.
    above = W.partitionBy(*by).orderBy(F.desc("_top")).rowsBetween(W.unboundedPreceding, 0)
    across = F.col("p").cast("double") * (F.sum("n").over(above) - F.col("n"))
    totals = (
        per_range.withColumn("_across", across)
        .groupBy(*by)
        .agg(
            F.sum(F.col("_won") + F.col("_across")).alias("_pairs"),
            F.sum("p").alias("n_positive"),
            F.sum("n").alias("n_negative"),
        )
    )
    size = F.col("n_positive").cast("double") * F.col("n_negative")
    return totals.select(
        *by, "n_positive", "n_negative", F.try_divide(F.col("_pairs"), size).alias("roc_auc")
    )


def metrics_by_horizon(
    predictions: DataFrame, *, threshold: float = C.TIERS.hypoxic, by: Sequence[str] = ()
) -> DataFrame:
    """Weighted scores, F1 and AUC per horizon, to find how far ahead forecasts hold."""
    groups = [*by, "horizon"]
    scores = weighted_scores(predictions, by=groups)
    f1 = threshold_sweep(predictions, thresholds=[threshold], by=groups).select(*groups, "f1")
    auc = roc_auc(predictions, threshold=threshold, by=groups).select(*groups, "roc_auc")
    return scores.join(f1, groups).join(auc, groups)


def largest_reliable_horizon(by_horizon: DataFrame, *, min_auc: float = 0.7) -> DataFrame:
    """The last horizon before the first one whose AUC falls below ``min_auc`` or is unknown."""
    reached = F.coalesce(F.col("roc_auc") >= min_auc, F.lit(False))
    failing = F.min(F.when(~reached, F.col("horizon")))
    return by_horizon.agg(failing.alias("_bad"), F.max("horizon").alias("_max")).select(
        F.coalesce(F.col("_bad") - 1, F.col("_max")).alias("reliable_horizon")
    )


def event_study(
    events: DataFrame,
    predictions: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    value_cols: Sequence[str] = ("actual", "predicted"),
) -> DataFrame:
    """Observed and forecast values week by week for every event.

    Events are unfolded into their weeks, which are gathered per series: forecasts then meet all weeks of their own
    series at once and stay where they are when they, and the events, are spread by series over as many tasks. There
    are many times more forecasts than weeks of events, so it is the few weeks that are kept at hand and not sorted for.
    """
    week = F.explode(F.sequence("start_date", "end_date", F.expr("interval 7 days")))
    by_series = (
        events.select(*keys, "start_date", "end_date", week.alias("_week"))
        .groupBy(*keys)
        .agg(
            F.collect_set("_week").alias("_weeks"),
            F.collect_list(F.struct("_week", "start_date", "end_date")).alias("_events"),
        )
    )
    at = F.col(time_col)
    return (
        predictions.join(by_series.hint("shuffle_hash"), list(keys))
        .where(F.array_contains("_weeks", at))
        .select(
            *keys, time_col, "origin", "horizon", *value_cols, F.inline(F.filter("_events", lambda e: e["_week"] == at))
        )
        .select(*keys, "start_date", "end_date", time_col, "origin", "horizon", *value_cols)
    )


def event_summary(
    study: DataFrame,
    *,
    models: Sequence[str] = ("predicted",),
    keys: Sequence[str] = C.SERIES_KEYS,
) -> DataFrame:
    """Per event and horizon: mean observation, and mean error of each model."""
    return study.groupBy(*keys, "start_date", "end_date", "horizon").agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.avg("actual").alias("mean_actual"),
        *[F.avg(F.col(m) - F.col("actual")).alias(f"bias_{m}") for m in models],
        *[F.avg(F.abs(F.col(m) - F.col("actual"))).alias(f"mae_{m}") for m in models],
    )


def risk_by_date(
    forecasts: DataFrame,
    *,
    threshold: float = C.TIERS.hypoxic,
    quantile_cols: Sequence[str] = ("p10", "p50", "p90"),
    name: str = "risk",
) -> DataFrame:
    """Probability that the target week lies below the threshold."""
    p10, p50, p90 = (F.col(c) for c in quantile_cols)
    return forecasts.withColumn(name, crossing_probability(p10, p50, p90, threshold))


def expectation_check(
    metrics: DataFrame, expected: Mapping[str, tuple[float, float]] = EXPECTED_RANGES
) -> DataFrame:
    """Long table of metrics against the ranges in which they are plausible."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("value"),
                F.lit(low).alias("expected_low"),
                F.lit(high).alias("expected_high"),
            )
            for name, (low, high) in expected.items()
        ]
    )
    rest = [c for c in metrics.columns if c not in expected]
    long = metrics.select(*rest, F.inline(rows))
    verdict = (
        F.when(F.col("value") < F.col("expected_low"), "below")
        .when(F.col("value") > F.col("expected_high"), "above")
        .when(F.col("value").isNotNull(), "within")
    )
    return long.withColumn("verdict", verdict)
