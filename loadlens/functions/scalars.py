"""Numeric expressions whose null and rounding rules are fixed once, here."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-9


def sum0(x: Column) -> Column:
    """Sum that is 0, not null, over no values."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def sum_if(cond: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """Division that is null for a zero or null divisor, in every ANSI mode."""
    return num / F.nullif(den, F.lit(0.0))


def floor_eps(x: Column) -> Column:
    """Keep a divisor positive; a missing divisor stays missing."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(EPS)))


def true_if(cond: Column) -> Column:
    """A comparison with a missing side is False, never null."""
    return F.coalesce(cond, F.lit(False))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def hdd(t: Column, base: float = 15.0) -> Column:
    return F.when(t.isNotNull(), F.greatest(F.lit(float(base)) - t, F.lit(0.0)))


def cdd(t: Column, base: float = 24.0) -> Column:
    return F.when(t.isNotNull(), F.greatest(t - F.lit(float(base)), F.lit(0.0)))


def degree_hours(t: Column, base: float, mode: str = "cooling") -> Column:
    return cdd(t, base) if mode == "cooling" else hdd(t, base)


def power_factor(p: Column, q: Column) -> Column:
    return p / floor_eps(F.sqrt(p * p + q * q))


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(x)
    return F.when(
        (n >= 3) & (F.stddev_pop(x) > 0),
        F.skewness(x) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2),
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null below two pairs or without spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def scale_bin(kwh: Column) -> Column:
    return (
        F.when((kwh >= 0) & (kwh < 100), "0-100")
        .when((kwh >= 100) & (kwh < 1000), "100-1K")
        .when((kwh >= 1000) & (kwh < 10000), "1K-10K")
        .when(kwh >= 10000, "10K+")
    )


# Mean hours of daylight by month, January first.
DAYLIGHT_HOURS = (9.8, 10.8, 12.0, 13.2, 14.2, 14.8, 14.5, 13.6, 12.4, 11.2, 10.1, 9.5)


def daylight_hours(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(h) for h in DAYLIGHT_HOURS]), month.cast("int"))


def temperature_loss(temp: Column) -> Column:
    """Panel efficiency falls by 0.4 % per degree above 25."""
    return 1 - 0.004 * F.greatest(temp - 25, F.lit(0.0))


def restore_consumption(metered: Column, generation: Column) -> Column:
    return metered + F.greatest(generation, F.lit(0.0))
