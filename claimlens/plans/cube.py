"""The finest aggregate that the marts and report documents need.

One scan of the claims gives one row per (month, payer, specialty, denial
code, category, reason, aging bucket); marts and documents add its rows up.
Its size follows from the dimensions, not from the claims.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.functions.bands import aging_bucket
from claimlens.functions.rounding import int_days
from claimlens.operators.aging import ar_age

KEYS = ["claim_month", "payer", "specialty", "denial_code", "category", "reason", "bucket"]


def claim_cube(claims: DataFrame, as_of: dt.date) -> DataFrame:
    """The cube of ``recovery.with_recovery`` rows. Days are added up as decimals, so no order of adding moves them."""
    age = ar_age(as_of, "decision")
    is_open, billed, rec = F.col("is_open_ar"), F.col("billed_amount"), F.col("recovery_potential")
    days = F.col("days_to_resolve").cast("decimal(12,4)")
    rows = claims.withColumn("bucket", F.when(is_open, aging_bucket(int_days(age)))).withColumn("_old", is_open & (age > 90))

    def where(cond, value=None):
        return F.count_if(cond) if value is None else F.sum(F.when(cond, value))

    measures = {
        "claims": F.count(F.lit(1)), "denied": where(F.col("is_denied")), "underpaid": where(F.col("is_underpaid")),
        "gap": where(F.col("is_underpaid"), F.col("underpayment_gap")), "billed": F.sum(billed), "paid": F.sum("paid_amount"),
        "lost": where(F.col("is_denied"), billed), "open": where(is_open), "old": where(F.col("_old")), "open_billed": where(is_open, billed),
        "old_billed": where(is_open & (F.col("bucket") == P.AGING_BUCKETS[-1]), billed), "days": F.sum(days), "resolved": F.count(days),
        "opportunities": F.count("category"), "rec": where(F.col("category").isNotNull(), rec),
        "rec_high": where(F.col("category").isNotNull() & (F.col("recovery_confidence") == "High"), rec),
        "rec_under": where(F.col("category") == P.CATEGORY_UNDERPAYMENT, rec), "rec_appeal": where(F.col("category") == P.CATEGORY_APPEAL, rec),
    }
    return rows.groupBy(*KEYS).agg(*[c.alias(f"m_{k}") for k, c in measures.items()])


def rolled(cube: DataFrame, sets: list[list[str]], keys: list[str], names: dict[str, str]) -> DataFrame:
    """Cube rows added up over grouping sets, with ``_gid``. names: output column -> measure ("mean_days" too)."""
    def measure(m: str):
        if m == "mean_days":
            return F.try_divide(F.sum("m_days"), F.sum("m_resolved")).cast("decimal(16,8)")
        return F.sum(f"m_{m}")

    return cube.groupingSets(sets, *keys).agg(F.grouping_id().alias("_gid"), *[measure(m).alias(out) for out, m in names.items()])
