"""Rounding and numeric helpers.

Money is computed in DECIMAL(12,2) and reported as double. Ratios are rounded
through DECIMAL(24,6) so that HALF_UP rounding is applied to a decimal value,
never to a binary double (``round(0.285, 2)`` differs between engines on
doubles; on decimals it does not).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
WIDE = "decimal(24,6)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x) -> Column:
    """Cast to DECIMAL(12,2) (the storage type of every amount)."""
    return _c(x).cast(MONEY)


def rpt(x, n: int = 1) -> Column:
    """Report value: round ``x`` to ``n`` places via DECIMAL(24,6), as double."""
    return F.round(_c(x).cast(WIDE), n).cast("double")


def pct(num, den) -> Column:
    """100 * num / den with a NULL result when den is 0 (never raises)."""
    return F.try_divide(F.lit(100).cast("decimal(4,1)") * _c(num), _c(den))


def rate_pct(num, den, n: int = 1) -> Column:
    """Rounded percentage ``round(100 * num / den, n)`` as double."""
    return rpt(pct(num, den), n)


def int_days(x) -> Column:
    """Integer cast that rounds half-to-even first, so a fractional day count
    becomes the nearest integer (89.5 -> 90, 90.5 -> 90, 90.6 -> 91) rather
    than being truncated as a plain Spark cast would."""
    return F.bround(_c(x).cast("double"), 0).cast("int")


def rnd(x, n: int = 1) -> Column:
    """Like :func:`rpt` but keeps the DECIMAL result (for exact later
    arithmetic on rounded values)."""
    return F.round(_c(x).cast(WIDE), n)
