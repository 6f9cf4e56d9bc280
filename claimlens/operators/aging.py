"""Accounts-receivable aging: G3/G4 (submission clock, warehouse form),
G8 (decision clock mart), G16 (AR summary), G17 (payer x bucket matrix).

Two clocks (kept apart by name):
- ``submission``: days from claim date to the as-of date, for every open claim;
- ``decision``: days to resolve when known (a denied claim re-enters AR at
  its decision), else days since submission (pending claims).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.functions.bands import aging_bucket, bucket_order
from claimlens.functions.dates import days_between
from claimlens.functions.rounding import int_days, rpt

CLOCKS = ("submission", "decision")
BUCKET_COLUMNS = ["bucket_0_30", "bucket_31_60", "bucket_61_90", "bucket_90_plus"]


def ar_age(as_of: dt.date, clock: str) -> Column:
    """Age in days (double) of an open claim under the chosen clock."""
    if clock == "submission":
        return days_between("claim_date", as_of).cast("double")
    if clock == "decision":
        return F.coalesce(F.col("days_to_resolve"), days_between("claim_date", as_of).cast("double"))
    raise ValueError(f"clock must be one of {CLOCKS}, got {clock!r}")


def ar_aging_claims(claims: DataFrame, as_of: dt.date) -> DataFrame:
    """Claim-level aging, submission clock (warehouse form).

    Days are computed once per row and the bucket is derived from that
    column (the "compute once, reference many" form)."""
    base = claims.filter(F.col("status").isin(*P.OPEN_AR_STATUSES)).select(
        "claim_id",
        "payer_id",
        F.col("billed_amount").cast("double").alias("billed_amount"),
        days_between("claim_date", as_of).alias("days_outstanding"),
    )
    return base.withColumn("aging_bucket", aging_bucket("days_outstanding"))


def ar_aging_by_payer(claims: DataFrame, payers: DataFrame, as_of: dt.date) -> DataFrame:
    """Open AR by payer name and bucket, submission clock.

    Aggregates to (payer_id, bucket) before the dimension join, then to
    (payer_name, bucket)."""
    b = claims.filter(F.col("status").isin(*P.OPEN_AR_STATUSES)).select(
        "payer_id", "billed_amount", aging_bucket(days_between("claim_date", as_of)).alias("aging_bucket")
    )
    per_id = b.groupBy("payer_id", "aging_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("billed_amount").alias("s")
    )
    g = per_id.join(payers, "payer_id").groupBy("payer_name", "aging_bucket").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")
    )
    return g.select(
        "payer_name",
        "aging_bucket",
        F.col("n").cast("bigint").alias("claim_count"),
        F.round("s", 2).cast("double").alias("billed_in_bucket"),
    ).orderBy("payer_name", bucket_order("aging_bucket"))


def open_ar(stg: DataFrame, as_of: dt.date, clock: str = "decision") -> DataFrame:
    """Open claims with integer ``days_outstanding`` and ``aging_bucket``."""
    return stg.filter(F.col("is_open_ar")).select(
        "claim_id",
        "payer",
        "billed_amount",
        int_days(ar_age(as_of, clock)).alias("days_outstanding"),
    ).withColumn("aging_bucket", aging_bucket("days_outstanding"))


def ar_aging(stg: DataFrame, as_of: dt.date, clock: str = "decision") -> DataFrame:
    """Open AR by payer and bucket (decision clock by default)."""
    g = open_ar(stg, as_of, clock).groupBy("payer", "aging_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("billed_amount").alias("s")
    )
    return aging_from_counts(g)


def aging_from_counts(g: DataFrame) -> DataFrame:
    """G8 from (payer, aging_bucket, n open claims, s open billed)."""
    return g.select(
        "payer",
        "aging_bucket",
        bucket_order("aging_bucket").alias("bucket_order"),
        F.col("n").cast("bigint").alias("claim_count"),
        F.round("s", 2).cast("double").alias("billed_in_bucket"),
    ).orderBy("payer", "bucket_order")


def ar_aging_matrix(stg: DataFrame, as_of: dt.date, clock: str = "decision") -> DataFrame:
    """Payer x bucket matrix of open billed dollars, zero-filled, with
    the row total and the 90+ dollar share (NULL when the total is 0).

    The pivot values are given explicitly, so Spark needs no extra job to
    discover them, and it runs as one partial+final aggregate."""
    a = open_ar(stg, as_of, clock)
    return _matrix(a.groupBy("payer").pivot("aging_bucket", P.AGING_BUCKETS).agg(F.sum("billed_amount")))


def _matrix(p: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(22,2)")
    buckets = [F.coalesce(F.col(f"`{b}`"), zero) for b in P.AGING_BUCKETS]
    total = buckets[0] + buckets[1] + buckets[2] + buckets[3]
    return p.select(
        "payer",
        *[F.round(c, 2).cast("double").alias(n) for c, n in zip(buckets, BUCKET_COLUMNS)],
        F.round(total, 2).cast("double").alias("total"),
        rpt(F.try_divide(buckets[3] * F.lit(100), F.when(total != 0, total)), 1).alias("pct_90plus"),
    ).orderBy("payer")


def matrix_from_counts(aging: DataFrame) -> DataFrame:
    """G17 from the G8 mart (payer, aging_bucket, billed_in_bucket): its cents are whole, so sums agree."""
    cents = F.col("billed_in_bucket").cast("decimal(22,2)")
    p = aging.withColumn("_c", cents).groupBy("payer").pivot("aging_bucket", P.AGING_BUCKETS).agg(F.sum("_c"))
    return _matrix(p)


def ar_summary(scored_payers: DataFrame) -> DataFrame:
    """One-row AR summary from the per-payer scorecard frame produced by
    :func:`claimlens.operators.scorecard.scorecard_frame` (it already carries
    the per-payer open AR dollars, so no claim-grain rescan or cross join).

    total_ar_outstanding and ar_90plus are whole dollars (decision clock, 90+ by
    integer-day bucket); ar_90plus_pct is the *dollar* share."""
    s = scored_payers
    g = s.agg(
        F.sum("ar_billed").alias("t"),
        F.sum("ar_billed_90plus").alias("o"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("payer", "payer_rank").alias("best"),
        F.max_by("payer", "payer_rank").alias("worst"),
    )
    return g.select(
        F.coalesce(F.round("t", 0), F.lit(0)).cast("double").alias("total_ar_outstanding"),
        F.coalesce(F.round("o", 0), F.lit(0)).cast("double").alias("ar_90plus"),
        rpt(F.try_divide(F.col("o") * F.lit(100), F.when(F.col("t") != 0, F.col("t"))), 1).alias("ar_90plus_pct"),
        F.col("n").cast("bigint").alias("n_payers"),
        F.col("best").alias("best_payer"),
        F.col("worst").alias("worst_payer"),
    )


def aging_share(matrix: DataFrame) -> DataFrame:
    """Each bucket's share of the payer's open AR (1 dp); payers with a
    zero total are skipped."""
    m = matrix.filter(F.col("total") != 0)
    return m.select(
        "payer",
        *[
            rpt(F.col(c).cast("decimal(24,6)") * F.lit(100) / F.col("total").cast("decimal(24,6)"), 1).alias(
                c.replace("bucket_", "share_")
            )
            for c in BUCKET_COLUMNS
        ],
    )
