"""G1: typed, flagged claims (the single place status semantics live)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.functions.dates import month_start
from claimlens.functions.rounding import MONEY

STAGED_COLUMNS = [
    "claim_id",
    "claim_date",
    "claim_month",
    "payer",
    "specialty",
    "billed_amount",
    "paid_amount",
    "status",
    "denial_code",
    "denial_reason",
    "days_to_resolve",
    "underpayment_gap",
    "is_denied",
    "is_underpaid",
    "is_open_ar",
]


def stg_claims(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Typed projection of a raw claim extract plus three status flags.

    Amounts are DECIMAL(12,2) (exact sums), days are double (they may be
    fractional in an extract). ``keep`` carries extra raw columns through
    (e.g. ``payer_id`` for the warehouse-form queries).
    """
    st = F.col("status")
    cols = [
        F.col("claim_id").cast("string").alias("claim_id"),
        F.col("claim_date").cast("date").alias("claim_date"),
        month_start("claim_date").alias("claim_month"),
        F.col("payer").cast("string").alias("payer"),
        F.col("specialty").cast("string").alias("specialty"),
        F.col("billed_amount").cast(MONEY).alias("billed_amount"),
        F.col("paid_amount").cast(MONEY).alias("paid_amount"),
        st.cast("string").alias("status"),
        F.col("denial_code").cast("string").alias("denial_code"),
        F.col("denial_reason").cast("string").alias("denial_reason"),
        F.col("days_to_resolve").cast("double").alias("days_to_resolve"),
        F.col("underpayment_gap").cast(MONEY).alias("underpayment_gap"),
        (st == P.STATUS_DENIED).alias("is_denied"),
        (st == P.STATUS_UNDERPAID).alias("is_underpaid"),
        st.isin(*P.OPEN_AR_STATUSES).alias("is_open_ar"),
    ]
    return raw.select(*cols, *(keep or []))


def report_view(stg: DataFrame) -> DataFrame:
    """The staged columns with amounts reported as double."""
    return stg.select(
        *[
            F.col(c).cast("double").alias(c) if c in ("billed_amount", "paid_amount", "underpayment_gap") else F.col(c)
            for c in STAGED_COLUMNS
        ]
    )
