"""Report label formatting (ids, month labels, money and percent text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def padded_id(prefix: str, n, width: int = 4) -> Column:
    """``prefix`` + zero-padded integer, e.g. DEMO-0007."""
    return F.format_string(f"{prefix}%0{width}d", _c(n))


def month_label(month) -> Column:
    """'Jul 24' style label of a month date."""
    return F.date_format(_c(month), "MMM yy")


def month_key(month) -> Column:
    """'2024-07' style key of a month date."""
    return F.date_format(_c(month), "yyyy-MM")


def month_from_key(key) -> Column:
    """Inverse of :func:`month_key` ('2024-07' -> DATE 2024-07-01)."""
    return F.to_date(_c(key), "yyyy-MM")


def money_text(x) -> Column:
    """'$1,234' (thousands separators, no decimals); x is rounded half-up in
    decimal first so the text is engine independent."""
    return F.concat(F.lit("$"), F.format_number(F.round(_c(x).cast("decimal(24,6)"), 0), 0))


def money_k_text(x) -> Column:
    """'$12K' (thousands, rounded half-up)."""
    k = F.round(_c(x).cast("decimal(24,6)") / F.lit(1000), 0).cast("bigint")
    return F.concat(F.lit("$"), k.cast("string"), F.lit("K"))


def pct_text(x, places: int = 1) -> Column:
    """'17.5%' with ``places`` decimals (half-up in decimal)."""
    r = F.round(_c(x).cast("decimal(24,6)"), places)
    return F.concat(F.format_number(r, places), F.lit("%"))
