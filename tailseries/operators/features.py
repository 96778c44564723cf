"""Predictors of the target depth: surface values, gradients, change, mixing, lags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tailseries import config as C

SURFACE_COLUMNS = {"Temp_C": "Surface_Temp_C", "O2_umol_L": "Surface_O2_umol_L"}


def _series(keys: Sequence[str], time_col: str):
    return W.partitionBy(*keys).orderBy(time_col)


def add_surface_values(
    target: DataFrame,
    all_depths: DataFrame,
    *,
    on: Sequence[str] = (C.STATION, C.TIME),
    depth_col: str = C.DEPTH,
    surface_depth: float = C.SURFACE_DEPTH_M,
    columns: Mapping[str, str] = SURFACE_COLUMNS,
) -> DataFrame:
    """Values of the surface series at the same time, NULL where it has none.

    The depth filter reaches the scan of both sides, so two depths are read, not all.
    """
    surface = all_depths.where(F.col(depth_col) == surface_depth).select(
        *on, *[F.col(c).alias(name) for c, name in columns.items()]
    )
    joined = target.join(surface, list(on), "left")
    return joined.select(*target.columns, *columns.values())


def spread_surface_values(
    df: DataFrame,
    *,
    on: Sequence[str] = (C.STATION, C.TIME),
    depth_col: str = C.DEPTH,
    surface_depth: float = C.SURFACE_DEPTH_M,
    columns: Mapping[str, str] = SURFACE_COLUMNS,
) -> DataFrame:
    """The same lookup when surface and target rows come out of one costly table.

    The table is evaluated once, and not shuffled again if it is clustered by the place.
    Rows of a group are the depths of one place and time.
    """
    at_surface = F.when(F.col(depth_col) == surface_depth, F.struct(*columns))
    found = F.max(at_surface).over(W.partitionBy(*on))
    return (
        df.withColumn("_surface", found)
        .withColumns({name: F.col("_surface")[c] for c, name in columns.items()})
        .drop("_surface")
    )


def add_vertical_gradients(df: DataFrame) -> DataFrame:
    """Surface minus bottom, for temperature and oxygen."""
    return df.withColumns(
        {
            "Vertical_Temp_Grad": F.col("Surface_Temp_C") - F.col("Temp_C"),
            "Vertical_O2_Grad": F.col("Surface_O2_umol_L") - F.col("O2_umol_L"),
        }
    )


def add_change(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    column: str = C.TARGET,
    name: str = "O2_Derivative_1W",
) -> DataFrame:
    """Difference to the row before; equals the weekly change on a complete grid."""
    previous = F.lag(column).over(_series(keys, time_col))
    return df.withColumn(name, F.col(column) - previous)


def add_mixing_energy(
    df: DataFrame, *, speed: str = "Wind_Speed_ms", name: str = "Wind_Mixing_Energy"
) -> DataFrame:
    return df.withColumn(name, F.col(speed) * F.col(speed))


def add_lags(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    column: str = "Chl_a",
    steps: Sequence[int] = (1, 2, 3, 4),
) -> DataFrame:
    w = _series(keys, time_col)
    return df.withColumns({f"{column}_lag_{k}W": F.lag(column, k).over(w) for k in steps})


def add_rolling_mean(
    df: DataFrame,
    *,
    column: str,
    weeks: int,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    name: str | None = None,
) -> DataFrame:
    """Mean of the last ``weeks`` rows, the current one included; unknown rows are skipped."""
    w = _series(keys, time_col).rowsBetween(1 - weeks, 0)
    return df.withColumn(name or f"{column}_mean_{weeks}W", F.avg(column).over(w))


def engineer_features(
    target: DataFrame,
    all_depths: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    surface_depth: float = C.SURFACE_DEPTH_M,
    include_change: bool = True,
) -> DataFrame:
    """All features. Raw wind direction needs no step, it is a column already.

    Run it on the complete grid, before rows with unknowns are dropped: change and lags
    count rows. ``keys`` must end with the depth; the ones before it name the place.
    """
    place = [k for k in keys if k != C.DEPTH]
    return target.transform(
        add_surface_values, all_depths, on=[*place, time_col], surface_depth=surface_depth
    ).transform(_derive, keys=keys, time_col=time_col, include_change=include_change)


def engineer_features_at(
    weekly: DataFrame,
    target_depth: float = C.TARGET_DEPTH_M,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    surface_depth: float = C.SURFACE_DEPTH_M,
    include_change: bool = True,
) -> DataFrame:
    """All features of one depth of the weekly table, which is evaluated once."""
    place = [k for k in keys if k != C.DEPTH]
    return (
        weekly.where(F.col(C.DEPTH).isin(surface_depth, target_depth))
        .transform(spread_surface_values, on=[*place, time_col], surface_depth=surface_depth)
        .where(F.col(C.DEPTH) == target_depth)
        .transform(_derive, keys=keys, time_col=time_col, include_change=include_change)
    )


def _derive(
    df: DataFrame, *, keys: Sequence[str], time_col: str, include_change: bool
) -> DataFrame:
    """Features that need the surface values or the rows before."""
    df = df.transform(add_vertical_gradients)
    if include_change:
        df = df.transform(add_change, keys=keys, time_col=time_col)
    return df.transform(add_mixing_energy).transform(add_lags, keys=keys, time_col=time_col)
