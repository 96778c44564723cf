"""Reports on prepared data: interpolation, imbalance, skewness, weights, profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tailseries import config as C
from tailseries.functions.measures import below, deficit
from tailseries.operators.labels import imbalance_columns


def interpolation_audit(
    df: DataFrame,
    *,
    by: Sequence[str] = (),
    target: str = C.TARGET,
    threshold: float = C.TIERS.hypoxic,
) -> DataFrame:
    """How much of what is known was filled in; needs the flags of ``weekly_series``."""
    known = F.col(target).isNotNull()
    filled = known & ~F.col(f"{target}_observed")
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.count_if(known).alias("n_known"),
        F.count_if(filled).alias("n_filled"),
        F.count_if(filled & below(F.col(target), threshold)).alias("n_filled_below"),
    )
    return counts.withColumns(
        {
            "filled_share": F.try_divide("n_filled", "n_known"),
            "filled_below_share": F.try_divide("n_filled_below", "n_known"),
        }
    )


def imbalance_by_period(
    df: DataFrame, *, time_col: str = C.TIME, target: str = C.TARGET, tiers: C.Tiers = C.TIERS
) -> DataFrame:
    """Shares below each threshold by calendar month, by decade and in total, in one pass."""
    dated = df.select(
        F.month(time_col).alias("month"),
        (F.floor(F.year(time_col) / 10) * 10).cast("int").alias("decade"),
        target,
    )
    month, decade = F.col("month"), F.col("decade")
    return dated.groupingSets([[month], [decade], []], month, decade).agg(
        F.count(target).alias("n_known"), *imbalance_columns(target, tiers)
    )


def sample_skewness(x: Column) -> Column:
    """Skewness corrected for sample size; NULL below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when(
        (n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    )


def skewness_audit(
    df: DataFrame,
    *,
    by: Sequence[str] = (),
    target: str = C.TARGET,
    threshold: float = C.TIERS.hypoxic,
) -> DataFrame:
    """Skewness of the target, of the positive deficit and of its ``log1p``."""
    gap = deficit(F.col(target), threshold)
    positive = F.when(gap > 0, gap)
    return df.groupBy(*by).agg(
        sample_skewness(F.col(target)).alias("skew_target"),
        F.count(positive).alias("n_deficit"),
        sample_skewness(positive).alias("skew_deficit"),
        sample_skewness(F.log1p(positive)).alias("skew_log_deficit"),
    )


def weight_check(
    df: DataFrame,
    *,
    by: Sequence[str] = (),
    target: str = C.TARGET,
    weight: str = C.WEIGHT,
    threshold: float = C.TIERS.hypoxic,
    empty_ratio_as_zero: bool = False,
) -> DataFrame:
    """Mean weight below the threshold and elsewhere, their ratio, and the class counts.

    The ratio is NULL when a side is empty, or 0 with ``empty_ratio_as_zero``.
    """
    low = below(F.col(target), threshold)
    means = df.groupBy(*by).agg(
        (F.count(weight) > 0).alias("weight_present"),
        F.count_if(low).alias("n_below"),
        F.count_if(~low).alias("n_not_below"),
        F.avg(F.when(low, F.col(weight))).alias("mean_weight_below"),
        F.avg(F.when(~low, F.col(weight))).alias("mean_weight_not_below"),
    )
    ratio = F.try_divide("mean_weight_below", "mean_weight_not_below")
    if empty_ratio_as_zero:
        ratio = F.when(F.col("mean_weight_not_below") > 0, ratio).otherwise(F.lit(0.0))
    return means.withColumn("weight_ratio", ratio)


def class_counts(
    df: DataFrame,
    *,
    by: Sequence[str] = (),
    target: str = C.TARGET,
    threshold: float = C.TIERS.hypoxic,
) -> DataFrame:
    low = below(F.col(target), threshold)
    return df.groupBy(*by).agg(
        F.count_if(low).alias("n_below"), F.count_if(~low).alias("n_not_below")
    )


def dataset_profile(
    df: DataFrame, *, split_col: str = "split", time_col: str = C.TIME
) -> DataFrame:
    """Rows and date range per side of the split, and in total (``split`` is ``total``)."""
    grouped = df.rollup(split_col).agg(
        F.grouping(split_col).alias("_total"),
        F.count(F.lit(1)).alias("n_rows"),
        F.to_date(F.min(time_col)).alias("first_date"),
        F.to_date(F.max(time_col)).alias("last_date"),
    )
    label = F.when(F.col("_total") == 1, F.lit("total")).otherwise(F.col(split_col))
    return grouped.select(label.alias("split"), "n_rows", "first_date", "last_date")


def series_keys(df: DataFrame, keys: Sequence[str] = C.SERIES_KEYS) -> DataFrame:
    """The distinct series, rows without a full key left out."""
    complete = df.select(*keys)
    for k in keys:
        complete = complete.where(F.col(k).isNotNull())
    return complete.distinct()
