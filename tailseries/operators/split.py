"""Chronological train and validation split, exact to the row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F, types as T

from tailseries import config as C

_HEX_DIGITS = 3


def tie_bucket(tie_cols: Sequence[str]) -> Column:
    """One of 4096 groups of series, even in size whatever the keys look like."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in tie_cols])
    return F.substring(F.md5(text), 1, _HEX_DIGITS)


def _row_at(counts: DataFrame, order: str, position: Column) -> Row | None:
    """Of a table of counts ``n``, the row in which the given position falls.

    ``before`` is the number of rows ahead of it. The window is global; callers pass tables
    of one row per day or per tie bucket.
    """
    ordered = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumns(
        {"_upto": F.sum("n").over(ordered), "_total": F.sum("n").over(W.partitionBy())}
    ).withColumn("_position", position)
    return (
        placed.where(F.col("_upto") > F.col("_position"))
        .orderBy(order)
        .limit(1)
        .select(
            F.col(order).alias("at"),
            (F.col("_position") - F.col("_upto") + F.col("n")).alias("skip"),
        )
        .first()
    )


@dataclass(frozen=True)
class Cut:
    """The first validation row. Without bucket and key, the cut falls between two days."""

    day: date
    bucket: str | None = None
    key: tuple | None = None


def find_cut(
    df: DataFrame,
    *,
    ratio: float = C.TRAIN_RATIO,
    time_col: str = C.TIME,
    tie_cols: Sequence[str] = C.SERIES_KEYS,
) -> Cut | None:
    """The row at position ``floor(rows * ratio)`` in order of time, then tie bucket, then key.

    Counting narrows it down from day to tie bucket to row, each a job that returns one row;
    only the rows of one bucket of one day are ever put in order. The time column must be a
    DATE, which bounds the table of days. Without a row at that position there is no cut.
    """
    if not isinstance(df.schema[time_col].dataType, T.DateType):
        raise TypeError(f"{time_col} must be a DATE column")
    per_day = df.groupBy(F.col(time_col).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    day = _row_at(per_day, "day", F.floor(F.col("_total") * F.lit(float(ratio))))
    if day is None:
        return None
    if day["skip"] == 0:
        return Cut(day["at"])

    on_day = df.where(F.col(time_col) == F.lit(day["at"])).select(
        tie_bucket(tie_cols).alias("bucket"), *tie_cols
    )
    per_bucket = on_day.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    cell = _row_at(per_bucket, "bucket", F.lit(day["skip"]))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(*tie_cols))
    row = (
        on_day.where(F.col("bucket") == F.lit(cell["at"]))
        .withColumn("_rank", rank - 1)
        .where(F.col("_rank") == F.lit(cell["skip"]))
        .select(*tie_cols)
        .first()
    )
    return Cut(day["at"], cell["at"], tuple(row))


def chronological_split(
    df: DataFrame,
    *,
    ratio: float = C.TRAIN_RATIO,
    time_col: str = C.TIME,
    tie_cols: Sequence[str] = C.SERIES_KEYS,
    name: str = "split",
) -> DataFrame:
    """Add ``train`` or ``validation``; exactly ``floor(rows * ratio)`` rows are ``train``.

    Where the cut falls inside a day, the rows of that day are ordered by tie bucket and key;
    (time, key) must be unique. Labelling is a comparison with the one row of the cut, so the
    table itself is neither sorted nor shuffled. Hand in a stored table if it is costly: the
    cut is looked up in it first.
    """
    cut = find_cut(df, ratio=ratio, time_col=time_col, tie_cols=tie_cols)
    if cut is None:
        return df.withColumn(name, F.lit("train"))
    day = F.lit(cut.day)
    if cut.key is None:
        later = F.col(time_col) >= day
    else:
        place = F.struct(tie_bucket(tie_cols).alias("b"), *[F.col(c) for c in tie_cols])
        types = [df.schema[c].dataType for c in tie_cols]
        at = F.struct(
            F.lit(cut.bucket).alias("b"),
            *[F.lit(v).cast(t).alias(c) for c, v, t in zip(tie_cols, cut.key, types)],
        )
        later = (F.col(time_col) > day) | ((F.col(time_col) == day) & (place >= at))
    return df.withColumn(name, F.when(later, F.lit("validation")).otherwise(F.lit("train")))


def split_per_series(
    df: DataFrame,
    *,
    keys: Sequence[str] = C.SERIES_KEYS,
    ratio: float = C.TRAIN_RATIO,
    time_col: str = C.TIME,
    name: str = "split",
) -> DataFrame:
    """Cut every series at its own ``floor(rows * ratio)``."""
    series = W.partitionBy(*keys)
    rank = F.row_number().over(series.orderBy(time_col))
    size = F.count(F.lit(1)).over(series)
    return df.withColumn(
        name,
        F.when(rank <= F.floor(size * F.lit(float(ratio))), F.lit("train")).otherwise(
            F.lit("validation")
        ),
    )


def split_frames(df: DataFrame, *, name: str = "split") -> tuple[DataFrame, DataFrame]:
    train = df.where(F.col(name) == "train").drop(name)
    return train, df.where(F.col(name) == "validation").drop(name)
