"""Date helpers. The as-of date is always a parameter (never current_date())."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_start(d) -> Column:
    """First day of the month, as DATE (``date_trunc`` would give TIMESTAMP)."""
    return F.trunc(_c(d).cast("date"), "MM")


def days_between(start, as_of: dt.date) -> Column:
    """Whole days from ``start`` to the as-of date."""
    return F.datediff(F.lit(as_of), _c(start))


def trailing_start(as_of: dt.date, months: int) -> Column:
    """``as_of`` minus ``months`` months (a literal; pushes to the scan)."""
    return F.add_months(F.lit(as_of), -months)
