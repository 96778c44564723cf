"""Scalar rules on measured values: coercion, wind, severity, scaling, losses, risk.

Unknown is always NULL. Rules that must keep "unknown" apart from "not below" say so.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tailseries.config import TIERS, Tiers


def number(value: Column) -> Column:
    """Double, with unparseable text and NaN turned into NULL."""
    as_double = value.try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def wind_east(speed: Column, direction: Column) -> Column:
    return -speed * F.sin(F.radians(direction))


def wind_north(speed: Column, direction: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


def below(value: Column, threshold) -> Column:
    """True only when the value is known and below; unknown counts as not below."""
    return F.coalesce(value < threshold, F.lit(False))


def deficit(value: Column, threshold: float = TIERS.hypoxic) -> Column:
    """Distance under the threshold, 0 above it, NULL when unknown."""
    return F.when(value.isNotNull(), F.greatest(F.lit(threshold) - value, F.lit(0.0)))


def _by_tier(value: Column, tiers: Tiers, severe, hypoxic, watch, normoxic) -> Column:
    return (
        F.when(value < tiers.severe, F.lit(severe))
        .when(value < tiers.hypoxic, F.lit(hypoxic))
        .when(value < tiers.watch, F.lit(watch))
        .when(value.isNotNull(), F.lit(normoxic))
    )


def tier_weight(value: Column, tiers: Tiers = TIERS) -> Column:
    return _by_tier(
        value,
        tiers,
        tiers.severe_weight,
        tiers.hypoxic_weight,
        tiers.watch_weight,
        tiers.normoxic_weight,
    )


def tier_name(value: Column, tiers: Tiers = TIERS) -> Column:
    return _by_tier(value, tiers, "severe", "hypoxic", "watch", "normoxic")


def extreme_weight(
    value: Column, threshold: float = TIERS.hypoxic, tail: float = 100.0, other: float = 1.0
) -> Column:
    return F.when(below(value, threshold), F.lit(tail)).otherwise(F.lit(other))


def softplus_inverse(value: Column) -> Column:
    """``log(exp(v) - 1)``, written so that large values do not overflow."""
    safe = F.greatest(value, F.lit(1e-7))
    return F.when(value.isNotNull(), safe + F.log(-F.expm1(-safe)))


def softplus(value: Column) -> Column:
    """``log(1 + exp(v))``: back to a non-negative value."""
    return F.greatest(value, F.lit(0.0)) + F.log1p(F.exp(-F.abs(value)))


def pinball(actual: Column, predicted: Column, quantile: float) -> Column:
    """Quantile loss of one prediction."""
    error = actual - predicted
    return F.greatest(F.lit(quantile) * error, F.lit(quantile - 1.0) * error)


def crossing_probability(p10: Column, p50: Column, p90: Column, threshold) -> Column:
    """Probability of a value below ``threshold`` given three forecast quantiles.

    Piecewise linear between the quantiles, held at 0.05 and 0.95 outside of them.
    """
    level = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    lower = F.lit(0.1) + F.lit(0.4) * F.try_divide(level - p10, p50 - p10)
    upper = F.lit(0.5) + F.lit(0.4) * F.try_divide(level - p50, p90 - p50)
    return (
        F.when(p10.isNull() | p50.isNull() | p90.isNull(), F.lit(None).cast("double"))
        .when(level < p10, F.lit(0.05))
        .when(level > p90, F.lit(0.95))
        .when(level < p50, lower)
        .otherwise(F.coalesce(upper, F.lit(0.5)))
    )
