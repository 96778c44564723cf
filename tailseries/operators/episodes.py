"""Episodes: runs of consecutive weeks below a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tailseries import config as C
from tailseries.functions.measures import below


def mark_runs(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    target: str = C.TARGET,
    threshold: float = C.TIERS.hypoxic,
) -> DataFrame:
    """Add ``is_below`` (unknown is not below) and the run number ``run``."""
    series = W.partitionBy(*keys).orderBy(time_col)
    before = F.coalesce(F.lag("is_below").over(series), F.lit(False))
    upto = series.rowsBetween(W.unboundedPreceding, 0)
    return (
        df.withColumn("is_below", below(F.col(target), threshold))
        .withColumn("_turn", (F.col("is_below") != before).cast("int"))
        .withColumn("run", F.sum("_turn").over(upto))
        .drop("_turn")
    )


def find_episodes(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    target: str = C.TARGET,
    threshold: float = C.TIERS.hypoxic,
    with_id: bool = False,
) -> DataFrame:
    """One row per episode. Give it the complete grid: runs are runs of rows.

    An unknown week ends an episode. ``with_id`` numbers the episodes of a series from 1.
    With keys that are not floating-point numbers the grouping reuses the partitioning of
    the windows, so there is one shuffle in all.
    """
    runs = mark_runs(df, keys=keys, time_col=time_col, target=target, threshold=threshold)
    # Below-runs and other runs alternate and the first below-run has number 1.
    number = ((F.col("run") + 1) / 2).cast("long")
    episodes = (
        runs.where("is_below")
        .groupBy(*keys, "run")
        .agg(
            F.min(time_col).alias("start_date"),
            F.max(time_col).alias("end_date"),
            F.count(time_col).alias("duration_weeks"),
            F.min(target).alias("min_o2"),
        )
    )
    return episodes.select(
        *keys,
        *([number.alias("episode_id")] if with_id else []),
        "start_date",
        "end_date",
        "duration_weeks",
        "min_o2",
    )


def held_out_events(
    df: DataFrame, *, min_weeks: int = 2, from_date=None, **episode_options
) -> DataFrame:
    """Episodes of some length, optionally only those that start in the validation period."""
    events = find_episodes(df, **episode_options).where(F.col("duration_weeks") >= min_weeks)
    if from_date is not None:
        bound = from_date if isinstance(from_date, Column) else F.lit(from_date).cast("date")
        events = events.where(F.col("start_date") >= bound)
    return events


def episode_statistics(episodes: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Size of the catalogue and the longest duration."""
    return episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.coalesce(F.max("duration_weeks"), F.lit(0)).alias("longest_weeks"),
    )
