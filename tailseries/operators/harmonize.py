"""Bring sources onto one schema: numeric coercion, unit factors, union, gap-filling join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tailseries import config as C
from tailseries.functions.measures import number
from tailseries.operators.skew import spread_join


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unparseable text and NaN become NULL in ``columns``."""
    return df.withColumns({c: number(F.col(c)) for c in columns})


def convert_units(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """Multiply columns by a source's factor, after coercion so that text cannot fail it."""
    return df.withColumns({c: number(F.col(c)) * F.lit(f) for c, f in factors.items()})


def union_sources(*frames: DataFrame) -> DataFrame:
    """Stack sources by column name; a column a source lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fill_missing(
    left: DataFrame,
    supplement: DataFrame,
    *,
    keys: Sequence[str],
    column: str,
    supplement_column: str,
    one_per_key: bool = False,
) -> DataFrame:
    """Fill NULLs of ``column`` from a supplement with equal ``keys``; never override.

    Missing keys match missing keys, and a key that repeats in the supplement repeats the
    left row. ``one_per_key`` averages the supplement per key first, which keeps the row
    count and is the choice when one key may carry very many copies. Rows of heavy keys, the missing
    one included, are spread over tasks (``spread_join``).
    """
    right = supplement.select(*keys, F.col(supplement_column).alias("_fill"))
    if one_per_key:
        right = right.groupBy(*keys).agg(F.avg("_fill").alias("_fill"))
    filled = F.coalesce(F.col(column), F.col("_fill")).alias(column)
    return spread_join(left, right, keys, null_safe=True).select(
        [filled if c == column else F.col(c) for c in left.columns]
    )


def feature_columns(
    df: DataFrame, excluded: Sequence[str] = C.NON_FEATURES, *, target_feedback: bool = True
) -> list[str]:
    """Model inputs: every column that is not a key, target, label or calendar column.

    Without ``target_feedback`` columns made from the target's own values go too.
    """
    skip = {*excluded, C.STATION, *(() if target_feedback else C.TARGET_DERIVED)}
    return [c for c in df.columns if c not in skip]


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]
