"""Week labels and calendar encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def week_ending_monday(time: Column) -> Column:
    """Monday that closes the Tuesday-to-Monday week of ``time``."""
    return F.next_day(F.date_sub(F.to_date(time), 1), "MON")


def weeks_between(start: Column, end: Column) -> Column:
    """Whole weeks from one Monday to another."""
    return (F.datediff(end, start) / 7).cast("int")


def month_sin(date: Column) -> Column:
    return F.sin(F.lit(2 * math.pi / 12) * F.month(date))


def month_cos(date: Column) -> Column:
    return F.cos(F.lit(2 * math.pi / 12) * F.month(date))
