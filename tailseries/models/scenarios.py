"""Factorial experiments on a fitted forecaster: the mean response to every combination of driver values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tailseries.models.forecast import Forecaster, Frame

#: Combinations that one row is unfolded into at a time.
BLOCK = 1 << 16


def digits(number: Column, levels: Mapping[str, Sequence[float]]) -> dict[str, Column]:
    """The driver values of a combination: its number in mixed radix, the last driver changing fastest."""
    out, stride = {}, 1
    for name, values in reversed(list(levels.items())):
        # As whole numbers: a quotient of doubles is inexact from 2**53 on.
        at = F.call_function("div", number, F.lit(stride)) % F.lit(len(values))
        out[name] = F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at + 1).cast("int"))
        stride *= len(values)
    return dict(reversed(out.items()))


def combinations(levels: Mapping[str, Sequence[float]]) -> int:
    total = prod(len(v) for v in levels.values())
    if not levels or not total:
        raise ValueError("every driver needs a value")
    if total >= 1 << 63:
        raise ValueError(f"{total} combinations")
    return total


def scenario_grid(spark: SparkSession, levels: Mapping[str, Sequence[float]]) -> DataFrame:
    """All combinations of the drivers' values: scenario (its number from 0) and a column per driver.

    Each row decodes its own number on the executors; nothing is listed on the driver.
    """
    rows = spark.range(combinations(levels)).select(F.col("id").alias("scenario"))
    return rows.withColumns(digits(F.col("scenario"), levels))


def _unfolded(rows: DataFrame, total: int) -> DataFrame:
    """Every row once per combination, in two steps, so that no array is longer than BLOCK."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((total - 1) // BLOCK).cast("long"))))
    first = F.col("_block") * BLOCK
    within = F.sequence(first, F.least(first + BLOCK - 1, F.lit(total - 1).cast("long")))
    return blocks.withColumn("scenario", F.explode(within)).drop("_block")


def response_table(
    model: Forecaster, frame: Frame, levels: Mapping[str, Sequence[float]], *, by: Sequence[str] = ()
) -> DataFrame:
    """Mean forecast over a frame's origins under every combination: by, scenario, drivers, horizon, n, mean_predicted.

    All other inputs stay as they are. The mean of a linear form is the form at the means, so its rows are reduced
    to one per group before they meet the grid, and the size of the table does not multiply the work. Trees
    score every row under every combination, with partial means before the shuffle. The grid is unfolded from
    each row; a driver that is no input is an error.
    """
    missing = sorted(set(levels) - set(frame.inputs))
    if missing:
        raise ValueError(f"no inputs: {missing}")
    total = combinations(levels)
    by = list(by)
    horizons = list(model.models)
    if model.linear:
        used = dict.fromkeys(c for m in model.models.values() for c in m.columns)
        rows = frame.rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in used])
        rows = rows.where(F.col("n") > 0)
    else:
        rows = frame.rows
    scored = _unfolded(rows, total)
    drivers = digits(F.col("scenario"), levels)
    scored = scored.withColumns(drivers)
    scored = model.apply(scored, horizons)
    if not model.linear:
        scored = scored.groupBy(*by, "scenario", *levels).agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(f"predicted_{h}").alias(f"predicted_{h}") for h in horizons]
        )
    each = F.array(
        *[F.struct(F.lit(h).alias("horizon"), F.col(f"predicted_{h}").alias("mean_predicted")) for h in horizons]
    )
    return scored.select(*by, "scenario", *levels, "n", F.inline(each))
