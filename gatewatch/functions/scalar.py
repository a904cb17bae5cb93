"""Scalar column functions (F8-F14, F19). All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x) -> Column:
    """``Math.round`` semantics: ``floor(x + 0.5)`` (-2.5 -> -2). Spark's
    ``round`` rounds half away from zero (-2.5 -> -3), so it is not used."""
    return F.floor(_c(x) + F.lit(0.5)).cast("bigint")


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def percent(x, decimals: int = 0) -> Column:
    """Display percentage: ``round(100*x)`` or ``round(1000*x)/10``, half-up."""
    scale = 10 ** decimals
    return half_up(_c(x) * F.lit(100.0 * scale)) / F.lit(float(scale)) if decimals \
        else half_up(_c(x) * F.lit(100.0))


def safe_ratio(num, den) -> Column:
    """``num / den`` with a zero denominator replaced by 1."""
    d = _c(den)
    return _c(num) / F.when(d == 0, F.lit(1)).otherwise(d)


def unusual_hour(ts) -> Column:
    """1 when the hour is before 06:00 or after 22:59 (22 is normal)."""
    h = F.hour(_c(ts))
    return F.when((h < 6) | (h > 22), F.lit(1)).otherwise(F.lit(0))


def coerce_double(x) -> Column:
    """Non-numeric -> NULL, NaN -> NULL."""
    d = F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x.try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))
