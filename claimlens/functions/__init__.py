"""Column-expression helpers (rounding, bands, dates, labels)."""

from claimlens.functions import bands, dates, fmt, rounding

__all__ = ["bands", "dates", "fmt", "rounding"]
