"""Target selection, severity labels, sample weights, imbalance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tailseries import config as C
from tailseries.functions import measures as M


def select_depth(
    df: DataFrame, depth: float = C.TARGET_DEPTH_M, *, depth_col: str = C.DEPTH
) -> DataFrame:
    return df.where(F.col(depth_col) == depth)


def add_deficit(df: DataFrame, *, target: str = C.TARGET, tiers: C.Tiers = C.TIERS) -> DataFrame:
    return df.withColumn(C.DEFICIT, M.deficit(F.col(target), tiers.hypoxic))


def add_tier_weight(
    df: DataFrame, *, target: str = C.TARGET, tiers: C.Tiers = C.TIERS
) -> DataFrame:
    """Weight by severity; unknown stays unweighted instead of counting as harmless."""
    return df.withColumn(C.WEIGHT, M.tier_weight(F.col(target), tiers))


def add_tier(df: DataFrame, *, target: str = C.TARGET, tiers: C.Tiers = C.TIERS) -> DataFrame:
    return df.withColumn("tier", M.tier_name(F.col(target), tiers))


def label_risk(
    df: DataFrame,
    *,
    target_depth: float = C.TARGET_DEPTH_M,
    target: str = C.TARGET,
    tiers: C.Tiers = C.TIERS,
) -> DataFrame:
    """Rows of the target depth with deficit and weight."""
    return (
        df.transform(select_depth, target_depth)
        .transform(add_deficit, target=target, tiers=tiers)
        .transform(add_tier_weight, target=target, tiers=tiers)
    )


def with_extreme_weights(
    df: DataFrame, *, target: str = C.TARGET, tiers: C.Tiers = C.TIERS
) -> DataFrame:
    """Weight 100 below the hypoxic threshold and 1 otherwise, unknown included."""
    return df.withColumn(C.WEIGHT, M.extreme_weight(F.col(target), tiers.hypoxic))


def with_uniform_weights(df: DataFrame) -> DataFrame:
    return df.withColumn(C.WEIGHT, F.lit(1.0))


def imbalance_columns(target: str = C.TARGET, tiers: C.Tiers = C.TIERS) -> list:
    """Share of known rows below each threshold; the mean skips unknown rows."""
    known = F.col(target).isNotNull()
    return [
        F.avg(F.when(known, (F.col(target) < t).cast("double"))).alias(name)
        for name, t in tiers.thresholds().items()
    ]


def imbalance_report(
    df: DataFrame, *, by: Sequence[str] = (), target: str = C.TARGET, tiers: C.Tiers = C.TIERS
) -> DataFrame:
    return df.groupBy(*by).agg(*imbalance_columns(target, tiers))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any unknown value."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def completeness_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows before and after ``drop_incomplete``, share dropped, unknowns per column; one pass."""
    columns = list(subset) if subset else df.columns
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    counted = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )
    dropped = F.col("rows_before") - F.col("rows_after")
    return counted.select(
        "rows_before",
        "rows_after",
        dropped.alias("rows_dropped"),
        (100.0 * F.try_divide(dropped, F.col("rows_before"))).alias("dropped_pct"),
        *[f"null_{c}" for c in columns],
    )
