"""Hourly long-form weather to a continuous daily table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tailseries import config as C
from tailseries.functions.measures import wind_east, wind_north


def pivot_parameters(
    readings: DataFrame,
    *,
    by: Sequence[str] = (C.STATION,),
    time_col: str = "date",
    parameters: Mapping[str, str] = C.WEATHER_PARAMETERS,
) -> DataFrame:
    """Long to wide; repeated readings of one time and parameter are averaged."""
    wide = (
        readings.groupBy(*by, time_col)
        .pivot("parameter", list(parameters))
        .agg(F.avg("value"))
    )
    return wide.select(*by, time_col, *[F.col(f"`{p}`").alias(c) for p, c in parameters.items()])


def daily_means(
    wide: DataFrame,
    *,
    by: Sequence[str] = (C.STATION,),
    time_col: str = "date",
    value_cols: Sequence[str] = tuple(C.WEATHER_PARAMETERS.values()),
    day_col: str = C.TIME,
) -> DataFrame:
    """Mean per day over each station's own span; days without readings stay as NULL rows.

    Only days that exist are shuffled. The missing ones are unfolded from the day before
    the gap, so no calendar has to be joined.
    """
    days = wide.groupBy(*by, F.to_date(time_col).alias(day_col)).agg(
        *[F.avg(c).alias(c) for c in value_cols]
    )
    per_station = W.partitionBy(*by).orderBy(day_col)
    until = F.coalesce(F.date_sub(F.lead(day_col).over(per_station), 1), F.col(day_col))
    unfolded = (
        days.where(F.col(day_col).isNotNull())
        .withColumn("_until", until)
        .withColumn("_day", F.explode(F.sequence(F.col(day_col), F.col("_until"))))
    )
    known = F.col("_day") == F.col(day_col)
    return unfolded.select(
        *by, F.col("_day").alias(day_col), *[F.when(known, F.col(c)).alias(c) for c in value_cols]
    )


def add_wind_vector(
    df: DataFrame, *, speed: str = "Wind_Speed_ms", direction: str = "Wind_Dir_deg"
) -> DataFrame:
    """East and north components of the (already averaged) wind."""
    s, d = F.col(speed), F.col(direction)
    return df.withColumns({"Wind_U": wind_east(s, d), "Wind_V": wind_north(s, d)})


def weather_daily(readings: DataFrame, *, by: Sequence[str] = (C.STATION,)) -> DataFrame:
    """Pivot, daily mean and wind vector in one go."""
    daily = daily_means(pivot_parameters(readings, by=by), by=by)
    return add_wind_vector(daily).select(*by, C.TIME, *C.WEATHER_VALUES)
