"""From raw sources to the labelled table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tailseries import config as C
from tailseries.operators.asof import asof_nearest
from tailseries.operators.features import engineer_features_at
from tailseries.operators.harmonize import fill_missing, present, union_sources
from tailseries.operators.labels import drop_incomplete, label_risk
from tailseries.operators.resample import time_extent, weekly_series
from tailseries.sources.delimited import read_delimited


def load_ocean(
    spark: SparkSession,
    *,
    per_kg: str,
    per_litre: str,
    chlorophyll: str,
    station: str,
) -> DataFrame:
    """Both ocean files on one schema, chlorophyll gaps filled from the supplement."""
    ocean = union_sources(
        read_delimited(spark, per_kg, C.OCEAN_PER_KG, station=station),
        read_delimited(spark, per_litre, C.OCEAN_PER_LITRE, station=station),
    )
    supplement = read_delimited(spark, chlorophyll, C.CHLOROPHYLL, station=station)
    # Rows without a depth belong to no series; leaving them out before the join keeps
    # missing keys from matching each other.
    known = F.col(C.DEPTH).isNotNull()
    return fill_missing(
        ocean.where(known),
        supplement.where(known),
        keys=[C.STATION, C.TIME, C.DEPTH],
        column="Chl_a",
        supplement_column="Chl_a_supplement",
    )


def join_weather(
    ocean: DataFrame,
    weather: DataFrame,
    *,
    by: Sequence[str] = (),
    station_map: DataFrame | None = None,
    tolerance: timedelta = timedelta(days=C.ASOF_TOLERANCE_DAYS),
) -> DataFrame:
    """Nearest daily weather within the tolerance; rows without one keep NULLs.

    Weather of several stations needs either ``station_map``, which names for each ocean ``station_id`` the
    ``weather_station`` that serves it, or ``by``, columns of both tables: without these a row would get the weather of
    whichever station is nearest in time. An ocean station that the map lacks gets no weather; one that it
    names twice is an error. One station's weather, for all rows, comes without a station column.
    """
    values = present(weather, C.WEATHER_VALUES)
    if station_map is None:
        if C.STATION in weather.columns and not by:
            raise ValueError("weather has stations: give a station map, name columns to join by, or drop the column")
        return asof_nearest(ocean, weather, value_cols=values, by=by, tolerance=tolerance)
    served = station_map.select(F.col(C.STATION), F.col("weather_station").alias("_served")).distinct()
    twice = served.groupBy(C.STATION).count().where(F.col("count") > 1).select(C.STATION).limit(5).collect()
    if twice:
        raise ValueError(f"several weather stations for {sorted(str(r[0]) for r in twice)}")
    placed = ocean.join(served, C.STATION, "left")
    offered = weather.withColumnRenamed(C.STATION, "_served")
    joined = asof_nearest(placed, offered, value_cols=values, by=["_served", *by], tolerance=tolerance)
    return joined.select(*ocean.columns, *values)


def prepare_weekly(
    observations: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    depths: Sequence[float] | None = None,
    extent_from: DataFrame | None = None,
) -> DataFrame:
    """The weekly table of all series.

    ``depths`` limits the work to the depths that are used later; the grid still spans all
    data. ``extent_from`` is a cheaper table with the same times, such as the observations
    before the weather was joined.
    """
    extent = time_extent(observations if extent_from is None else extent_from)
    rows = observations if depths is None else observations.where(F.col(C.DEPTH).isin(list(depths)))
    return weekly_series(
        rows,
        keys=keys,
        value_cols=present(rows, C.VALUE_COLUMNS),
        extent=extent,
        cluster_by=[k for k in keys if k != C.DEPTH],
    )


def labelled_table(
    weekly: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    target_depth: float = C.TARGET_DEPTH_M,
    surface_depth: float = C.SURFACE_DEPTH_M,
    include_change: bool = True,
    complete_only: bool = True,
    tiers: C.Tiers = C.TIERS,
) -> DataFrame:
    """Features and labels of the target depth; by default only rows without unknowns.

    The complete grid goes through features and labels first, since lags and changes
    count rows.
    """
    featured = engineer_features_at(
        weekly,
        target_depth,
        keys=keys,
        surface_depth=surface_depth,
        include_change=include_change,
    )
    labelled = label_risk(featured, target_depth=target_depth, tiers=tiers)
    return drop_incomplete(labelled) if complete_only else labelled
