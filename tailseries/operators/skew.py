"""Equi-joins whose left side may hold a large share of its rows under few keys, NULL included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tailseries.sources.tables import staged

#: Keys with more rows than ROWS are spread, the HEAVY most frequent of them at most.
ROWS, HEAVY = 100_000, 256

_COUNT, _COPIES, _COPY, _MATE = "__rows", "__copies", "__copy", "__mate"


def heavy_keys(df: DataFrame, on: Sequence[str], *, rows: int = ROWS, heavy: int = HEAVY) -> DataFrame:
    """The ``heavy`` most frequent keys with more than ``rows`` rows: their columns, ``__rows``, ``__copies``.

    One aggregation with partial counts, and never more than ``heavy`` rows, however large ``df`` is; any
    other key has less than one part in ``heavy`` of all rows. A key gets one copy for every ``rows`` rows or
    for every such part of the heavy rows, whichever is more, so that there are fewer than 2 * ``heavy`` copies.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias(_COUNT)).where(F.col(_COUNT) > rows)
    top = staged(counts.orderBy(F.desc(_COUNT), *on).limit(heavy), "heavy-keys")
    total = top.agg(F.sum(_COUNT)).first()[0] or 0
    return top.withColumn(_COPIES, F.ceil(F.col(_COUNT) / max(rows, total / heavy)).cast("int"))


def _name(i: int) -> str:
    return f"__key{i}"


def _with_copies(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    hot = hot.select(*[F.col(f"`{c}`").alias(_name(i)) for i, c in enumerate(on)], _COPIES)
    met = _equal(on, True)
    out = df.join(F.broadcast(hot), met, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(_COPIES, F.lit(1)).alias(_COPIES))


def _equal(on: Sequence[str], null_safe: bool) -> Column:
    met = F.lit(True)
    for i, c in enumerate(on):
        a, b = F.col(f"`{c}`"), F.col(_name(i))
        met = met & (a.eqNullSafe(b) if null_safe else a == b)
    return met


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    how: str = "left",
    null_safe: bool = False,
    rows: int = ROWS,
    heavy: int = HEAVY,
) -> DataFrame:
    """The join of two tables on equal columns ``on``, with the rows of heavy keys spread over tasks.

    Same rows as ``left.join(right, on, how)``; with ``null_safe`` unknown keys equal each other. Rows of
    heavy keys of the left side are dealt over as many copies of the right rows, all others are joined as ever, and
    only right rows of at most ``heavy`` keys are repeated. Which copy a row goes to follows from its values,
    so a repeated task deals alike; rows equal in every column stay together.
    ``how``: inner, left, left_semi or left_anti. Columns other than ``on`` must have different names on the two sides.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: only the left side can be spread")
    clash = sorted(set(left.columns) & set(right.columns) - set(on))
    if clash:
        raise ValueError(f"both sides have columns {clash}")
    hot = heavy_keys(left, on, rows=rows, heavy=heavy)
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col(_COPIES)).cast("int")
    spread = _with_copies(left, hot, on).select(*[F.col(f"`{c}`") for c in left.columns], dealt.alias(_COPY))
    rest = [c for c in right.columns if c not in on]
    repeated = _with_copies(right, hot, on).select(
        *[F.col(f"`{c}`").alias(_name(i)) for i, c in enumerate(on)],
        *[F.col(f"`{c}`") for c in rest],
        F.explode(F.sequence(F.lit(0), F.col(_COPIES) - 1)).alias(_MATE),
    )
    joined = spread.join(repeated, _equal(on, null_safe) & (F.col(_COPY) == F.col(_MATE)), how)
    if how in ("left_semi", "left_anti"):
        rest = []
    return joined.select(*[F.col(f"`{c}`") for c in left.columns + rest])
