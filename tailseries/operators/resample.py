"""Weekly means on a complete grid, bounded interpolation, edge fill, time index.

Only weeks that hold data are shuffled and put in order. Each carries what the gap after
it needs (the nearest known values on both sides), and the gap is unfolded from there, so
neither a grid table nor a join is involved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tailseries import config as C
from tailseries.functions.calendar import month_cos, month_sin, week_ending_monday, weeks_between
from tailseries.functions.measures import number


def weekly_mean(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    value_cols: Sequence[str],
) -> DataFrame:
    """Mean per series and week (Tuesday to Monday, labelled by its Monday)."""
    complete = df
    for c in (*keys, time_col):
        complete = complete.where(F.col(c).isNotNull())
    return (
        complete.groupBy(*keys, week_ending_monday(F.col(time_col)).alias(time_col))
        .agg(*[F.avg(number(F.col(c))).alias(c) for c in value_cols])
    )


def time_extent(df: DataFrame, *, time_col: str = C.TIME, by: Sequence[str] = ()) -> DataFrame:
    """First and last day of the data, overall or per ``by``; defines the weekly grid."""
    day = F.to_date(time_col)
    return df.groupBy(*by).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


#: Grid rows that one task puts in order, about 1 KB each at nine columns.
ROWS_PER_TASK = 500_000


def series_tasks(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    rows_per_task: int = ROWS_PER_TASK,
) -> int:
    """Tasks over which to spread the series of ``df``, so that the grid rows of a task don't grow with the data.

    Rows are weeks times series, the latter counted approximately in one pass. Never less than the session's cores.
    Hand in a cheap table with the same series and times when the input is the result of joins.
    """
    day = F.to_date(time_col)
    seen = df.agg(
        F.approx_count_distinct(F.struct(*keys)).alias("series"),
        (F.datediff(F.max(day), F.min(day)) / 7 + 1).alias("weeks"),
    ).first()
    rows = seen["series"] * (seen["weeks"] or 0)
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / rows_per_task))


def _grid_bounds(weeks: DataFrame, extent: DataFrame, extent_by: Sequence[str]) -> DataFrame:
    """Attach ``_start`` (first Monday) and ``_steps`` (index of the last Monday)."""
    start = F.next_day(F.date_sub("first_day", 1), "MON")
    steps = F.floor(F.datediff(F.col("last_day"), start) / 7).cast("int")
    bounds = F.struct(start.alias("start"), steps.alias("steps")).alias("_grid")
    if extent_by:
        return weeks.join(extent.select(*extent_by, bounds), list(extent_by))
    return weeks.withColumn("_grid", extent.select(bounds).scalar())


def _unfold(
    weeks: DataFrame,
    *,
    keys: Sequence[str],
    time_col: str,
    value_cols: Sequence[str],
    extent: DataFrame,
    extent_by: Sequence[str],
    ends: dict[str, Column] | None = None,
    lines: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per grid week, next to the columns of the data week it was unfolded from.

    ``_i`` is the index of the data week and ``_j`` that of the row. The first data week of
    a series also covers what lies before it, and every data week what lies between it and
    the next one. A data week after the last grid Monday offers no values, but its series
    still gets its rows.
    """
    indexed = _grid_bounds(weeks, extent, extent_by).withColumn(
        "_i", weeks_between(F.col("_grid.start"), F.col(time_col))
    )
    on_grid = F.col("_i") <= F.col("_grid.steps")
    indexed = indexed.withColumns({c: F.when(on_grid, F.col(c)) for c in value_cols})
    asc = W.partitionBy(*keys).orderBy("_i")
    ordered = indexed.withColumns(
        {
            "_from": F.when(F.lag("_i").over(asc).isNull(), F.lit(0)).otherwise(F.col("_i")),
            "_to": F.least(
                F.coalesce(F.lead("_i").over(asc) - 1, F.col("_grid.steps")), F.col("_grid.steps")
            ),
            **(ends or {}),
        }
    )
    return (
        ordered.where(F.col("_from") <= F.col("_to"))
        .withColumns(lines or {"_line": F.lit(None)})
        .withColumn("_j", F.explode(F.sequence("_from", "_to")))
        .withColumn(time_col, F.date_add(F.col("_grid.start"), F.col("_j") * 7))
    )


def weekly_grid(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    value_cols: Sequence[str],
    extent: DataFrame | None = None,
    extent_by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Weekly means on every Monday of the extent; weeks without data hold NULLs.

    ``extent`` (see ``time_extent``) defaults to the span of the whole input. Hand in that
    of a cheaper table with the same times when the input is the result of joins.
    ``extent_by`` gives each of its groups a grid of its own. ``tasks`` (see ``series_tasks``) is the number of tasks
    over which the series are spread, here and in later steps per series; else Spark chooses by the size of the
    shuffled means, which the grid rows made of them may exceed many times.
    """
    extent = extent if extent is not None else time_extent(df, time_col=time_col, by=extent_by)
    weeks = weekly_mean(df, keys=keys, time_col=time_col, value_cols=value_cols)
    if tasks:
        weeks = weeks.repartition(tasks, *[F.col(c) for c in keys])
    rows = _unfold(
        weeks,
        keys=keys,
        time_col=time_col,
        value_cols=value_cols,
        extent=extent,
        extent_by=extent_by,
    )
    known = F.col("_j") == F.col("_i")
    return rows.select(
        *keys,
        time_col,
        F.col("_j").alias(C.TIME_INDEX),
        *[F.when(known, F.col(c)).alias(c) for c in value_cols],
    )


def _line(before: Column, after: Column, limit: int) -> Column:
    """The line to follow between two known points, each a struct of index and value.

    Value at index ``j`` is ``base + slope * (j - at)`` up to ``upto``. Past the last or ahead
    of the first known point the nearest one is repeated.
    """
    end = F.lit(2**31 - 1)
    slope = F.try_divide(after["v"] - before["v"], (after["i"] - before["i"]).cast("double"))
    flat = before.isNull() | after.isNull()
    return F.struct(
        F.coalesce(before["v"], after["v"]).alias("base"),
        F.coalesce(slope, F.lit(0.0)).alias("slope"),
        F.coalesce(before["i"], F.lit(0)).alias("at"),
        F.when(flat, end).otherwise(before["i"] + F.lit(limit)).alias("upto"),
    )


def _on_line(index: Column, line: Column) -> Column:
    value = line["base"] + line["slope"] * (index - line["at"])
    return F.when(index <= line["upto"], value)


def weekly_series(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    value_cols: Sequence[str],
    limit: int = C.INTERPOLATION_LIMIT_WEEKS,
    extent: DataFrame | None = None,
    extent_by: Sequence[str] = (),
    observed_flags: bool = False,
    cluster_by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """The prepared weekly table: means, gaps filled, time index and month encoding.

    Of a gap between two known weeks the first ``limit`` are interpolated and the rest
    stays NULL; leading and trailing gaps repeat the nearest known value; a column without
    any value stays NULL. ``observed_flags`` adds ``<column>_observed``. ``cluster_by``, some
    of the keys, puts all series of one place together, so that later steps within a place
    need no further shuffle; the weeks of a place must fit a task. ``tasks`` as in ``weekly_grid``.
    """
    extent = extent if extent is not None else time_extent(df, time_col=time_col, by=extent_by)
    return unfold_weeks(
        weekly_mean(df, keys=keys, time_col=time_col, value_cols=value_cols),
        keys=keys,
        time_col=time_col,
        value_cols=value_cols,
        limit=limit,
        extent=extent,
        extent_by=extent_by,
        observed_flags=observed_flags,
        cluster_by=cluster_by,
        tasks=tasks,
    )


def unfold_weeks(
    weeks: DataFrame,
    *,
    extent: DataFrame,
    keys: Sequence[str] = C.SERIES_KEYS,
    time_col: str = C.TIME,
    value_cols: Sequence[str],
    limit: int = C.INTERPOLATION_LIMIT_WEEKS,
    extent_by: Sequence[str] = (),
    observed_flags: bool = False,
    cluster_by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """``weekly_series`` from the table of ``weekly_mean``, whose ``extent`` is that of the samples.

    Where several steps read the series, the weeks that hold data are what to store: they are far fewer than the
    grid's, and unfolded again wherever they are read.
    """
    if cluster_by or tasks:
        weeks = weeks.repartition(*([tasks] if tasks else []), *[F.col(c) for c in cluster_by or keys])
    # The backward look is a forward frame over descending order: a frame that ends at
    # "unbounded following" would be evaluated anew for every row.
    upto = W.partitionBy(*keys).orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, -1)
    ends = {}
    for c in value_cols:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        ends[f"_prev_{c}"] = F.last(point, ignorenulls=True).over(upto)
        ends[f"_next_{c}"] = F.last(point, ignorenulls=True).over(after)
    rows = _unfold(
        weeks,
        keys=keys,
        time_col=time_col,
        value_cols=value_cols,
        extent=extent,
        extent_by=extent_by,
        ends=ends,
        lines={
            f"_line_{c}": _line(F.col(f"_prev_{c}"), F.col(f"_next_{c}"), limit)
            for c in value_cols
        },
    )
    j, i = F.col("_j"), F.col("_i")
    values, flags = [], []
    for c in value_cols:
        ahead_of_all = F.coalesce(F.col(c), F.col(f"_next_{c}.v"))
        inside = _on_line(j, F.col(f"_line_{c}"))
        values.append(F.when(j < i, ahead_of_all).otherwise(inside).alias(c))
        flags.append(((j == i) & F.col(c).isNotNull()).alias(f"{c}_observed"))
    return rows.select(
        *keys,
        time_col,
        j.alias(C.TIME_INDEX),
        *values,
        month_sin(F.col(time_col)).alias("month_sin"),
        month_cos(F.col(time_col)).alias("month_cos"),
        *(flags if observed_flags else []),
    )


def interpolate_bounded(
    df: DataFrame,
    *,
    keys: Sequence[str],
    index_col: str = C.TIME_INDEX,
    value_cols: Sequence[str],
    limit: int = C.INTERPOLATION_LIMIT_WEEKS,
) -> DataFrame:
    """The same filling for a table that already has one row per step of every series."""
    asc = W.partitionBy(*keys).orderBy(index_col).rowsBetween(W.unboundedPreceding, 0)
    desc = W.partitionBy(*keys).orderBy(F.desc(index_col)).rowsBetween(W.unboundedPreceding, 0)
    i = F.col(index_col)
    ends = {}
    for c in value_cols:
        point = F.when(F.col(c).isNotNull(), F.struct(i.alias("i"), F.col(c).alias("v")))
        ends[f"_prev_{c}"] = F.last(point, ignorenulls=True).over(asc)
        ends[f"_next_{c}"] = F.last(point, ignorenulls=True).over(desc)
    filled = {
        c: _on_line(i, _line(F.col(f"_prev_{c}"), F.col(f"_next_{c}"), limit)) for c in value_cols
    }
    return df.withColumns(ends).withColumns(filled).select(*df.columns)
