"""Denial-rate products: G2 (payer, trailing window), G6/G7 (monthly trend,
raw vs rounded month-over-month), G11-G15 (report breakdowns).

All aggregates are single-pass ``groupBy().agg()`` with filtered counts, so
Spark runs a partial (map-side) aggregate before the shuffle: a payer or month
holding a third of all claims costs one row per map task in the exchange,
not a third of the data. Month-over-month windows run over the monthly
aggregate (one row per month), never over claims.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.functions.bands import specialty_severity
from claimlens.functions.dates import trailing_start
from claimlens.functions.rounding import pct, rnd, rpt
from claimlens.session import ensure_checkpoint_dir


# --- G2: denial rate by payer over a trailing window -------------------------------

def denial_rate_by_payer(
    claims: DataFrame,
    payers: DataFrame,
    as_of: dt.date,
    months: int = 12,
    pre_aggregate: bool = True,
) -> DataFrame:
    """Warehouse form: ``claims(payer_id, status, claim_date)`` ⋈ ``payers``.

    The window filter is a literal range on ``claim_date`` so it prunes
    partitions/row groups in the scan. With ``pre_aggregate`` the claims are
    reduced to one row per payer before the dimension join (the join then
    touches #payers rows); the plain form joins first. Both group by
    ``payer_name`` at the end, so they agree even if two ids share a name.
    """
    start = trailing_start(as_of, months)
    in_window = F.col("claim_date") >= start
    if "claim_month" in claims.columns:
        # implied by the date bound; lets a month-partitioned table skip folders
        in_window = in_window & (F.col("claim_month") >= F.trunc(start, "MM"))
    window = claims.filter(in_window).select("payer_id", "status")
    denied = (F.col("status") == P.STATUS_DENIED).cast("int")
    if pre_aggregate:
        per_id = window.groupBy("payer_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(denied).alias("d")
        )
        joined = per_id.join(payers, "payer_id")
        agg = joined.groupBy("payer_name").agg(F.sum("n").alias("total_claims"), F.sum("d").alias("denied_claims"))
    else:
        joined = window.join(payers, "payer_id")
        agg = joined.groupBy("payer_name").agg(
            F.count(F.lit(1)).alias("total_claims"), F.sum(denied).alias("denied_claims")
        )
    return agg.select(
        "payer_name",
        F.col("total_claims").cast("bigint").alias("total_claims"),
        F.col("denied_claims").cast("bigint").alias("denied_claims"),
        rpt(pct("denied_claims", "total_claims"), 1).alias("denial_rate_pct"),
    ).orderBy(F.desc("denial_rate_pct"), "payer_name")


# --- G6 / G7: monthly trend ---------------------------------------------------------

def _monthly_counts(stg: DataFrame) -> DataFrame:
    return stg.groupBy("claim_month").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_denied")).alias("d")
    )


def monthly_denial_trend(stg: DataFrame) -> DataFrame:
    """Month-over-month change of the *rounded* monthly rate.

    The lag runs over the monthly aggregate only (one row per month)."""
    return trend_from_counts(_monthly_counts(stg))


def trend_from_counts(counts: DataFrame) -> DataFrame:
    """G7 from monthly counts (claim_month, n claims, d denied)."""
    w = Window.orderBy("claim_month")
    m = counts.withColumn("_rate", rnd(pct("d", "n"), 1))
    m = m.withColumn("_prior", F.lag("_rate").over(w))
    return m.select(
        "claim_month",
        F.col("n").cast("bigint").alias("claims_submitted"),
        F.col("d").cast("bigint").alias("denied_claims"),
        F.col("_rate").cast("double").alias("denial_rate_pct"),
        F.col("_prior").cast("double").alias("prior_month_rate_pct"),
        rpt(F.col("_rate") - F.col("_prior"), 1).alias("mom_change_pts"),
    ).orderBy("claim_month")


def monthly_trend_raw(stg: DataFrame) -> DataFrame:
    """Month-over-month change of the *unrounded* ratio, rounded once."""
    w = Window.orderBy("claim_month")
    m = _monthly_counts(stg).withColumn("_raw", pct("d", "n"))
    return m.select(
        "claim_month",
        F.col("n").cast("bigint").alias("total_claims"),
        F.col("d").cast("bigint").alias("denied_claims"),
        rpt("_raw", 1).alias("denial_rate_pct"),
        rpt(F.col("_raw") - F.lag("_raw").over(w), 1).alias("pct_change_vs_prior_month"),
    ).orderBy("claim_month")


# --- G11-G15: report breakdowns -----------------------------------------------------

def _breakdown(stg: DataFrame, key: str, with_paid: bool) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(F.col("is_denied")).alias("denied"),
        F.sum(F.when(F.col("is_underpaid"), F.col("underpayment_gap"))).alias("_under"),
        F.sum("billed_amount").alias("_billed"),
    ]
    if with_paid:
        aggs.append(F.sum("paid_amount").alias("_paid"))
    g = stg.groupBy(key).agg(*aggs)
    cols = [
        key,
        F.col("total_claims").cast("bigint").alias("total_claims"),
        F.col("denied").cast("bigint").alias("denied"),
        F.coalesce(F.round("_under", 2), F.lit(0)).cast("double").alias("underpaid_amt"),
        F.round("_billed", 2).cast("double").alias("billed"),
    ]
    if with_paid:
        cols.append(F.round("_paid", 2).cast("double").alias("paid"))
    cols.append(rpt(pct("denied", "total_claims"), 1).alias("denial_rate_pct"))
    return g.select(*cols)


def monthly_breakdown(stg: DataFrame) -> DataFrame:
    """Per month: claims, denied, underpaid dollars, billed, rate."""
    return _breakdown(stg, "claim_month", with_paid=False).orderBy("claim_month")


def payer_breakdown(stg: DataFrame, ordered: bool = True) -> DataFrame:
    """Per payer, highest denial rate first (``ordered=False`` skips the
    sort when the caller reorders anyway)."""
    b = _breakdown(stg, "payer", with_paid=True)
    return b.orderBy(F.desc("denial_rate_pct"), "payer") if ordered else b


def specialty_breakdown(stg: DataFrame) -> DataFrame:
    """Per specialty with the severity band of its denial rate."""
    b = _breakdown(stg, "specialty", with_paid=False)
    return b.withColumn("severity", specialty_severity("denial_rate_pct"))


def reason_breakdown(stg: DataFrame, seed: DataFrame) -> DataFrame:
    """Denied claims per denial code with the code's label, most
    frequent first. Codes missing from the seed keep a NULL label."""
    d = stg.filter(F.col("is_denied")).groupBy("denial_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("billed_amount").alias("_lost")
    )
    labels = seed.select("denial_code", F.col("denial_reason_label").alias("label"))
    return d.join(labels, "denial_code", "left").select(
        "denial_code",
        F.col("n").cast("bigint").alias("claim_count"),
        F.round("_lost", 2).cast("double").alias("billed_lost"),
        "label",
    ).orderBy(F.desc("claim_count"), "denial_code")


def kpi_denial(stg_with_recovery: DataFrame) -> DataFrame:
    """One-row KPI strip. Expects :func:`recovery.with_recovery` output
    (one pass computes the recoverable dollars alongside the counts)."""
    s = stg_with_recovery
    g = s.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("billed_amount").alias("_billed"),
        F.sum("paid_amount").alias("_paid"),
        F.count_if(F.col("is_denied")).alias("_d"),
        F.count_if(F.col("is_underpaid")).alias("_u"),
        F.sum(F.when(F.col("category").isNotNull(), F.col("recovery_potential"))).alias("_rec"),
        F.avg(F.col("days_to_resolve").cast("decimal(12,4)")).alias("_days"),
    )
    return g.select(
        F.col("n").cast("bigint").alias("total_claims"),
        F.coalesce(F.round("_billed", 0), F.lit(0)).cast("double").alias("total_billed"),
        F.coalesce(F.round("_paid", 0), F.lit(0)).cast("double").alias("total_paid"),
        rpt(pct("_d", "n"), 1).alias("denial_rate"),
        rpt(pct("_u", "n"), 1).alias("underpay_rate"),
        F.coalesce(F.round("_rec", 0), F.lit(0)).cast("double").alias("total_recoverable"),
        rpt("_days", 1).alias("avg_days_to_resolve"),
    )


def slice_claims(stg: DataFrame, payer=None, specialty=None, period=None) -> DataFrame:
    """F9 report slicers: each argument None means 'all'. ``period`` is a
    (start, end) pair of dates, inclusive start, exclusive end."""
    out = stg
    if payer is not None:
        out = out.filter(F.col("payer").isin(*([payer] if isinstance(payer, str) else payer)))
    if specialty is not None:
        out = out.filter(F.col("specialty").isin(*([specialty] if isinstance(specialty, str) else specialty)))
    if period is not None:
        start, end = period
        cond = (F.col("claim_date") >= F.lit(start)) & (F.col("claim_date") < F.lit(end))
        if "claim_month" in stg.columns:  # implied; prunes month folders
            cond = cond & (F.col("claim_month") >= F.trunc(F.lit(start), "MM")) & (F.col("claim_month") < F.lit(end))
        out = out.filter(cond)
    return out


# --- G11-G15 in one pass ------------------------------------------------------------

BLOCK_KEYS = ["claim_month", "payer", "specialty", "denial_code"]
# grouping_id of each grouping set: one bit per key, set when the key is NOT grouped
_GID = {"claim_month": 0b0111, "payer": 0b1011, "specialty": 0b1101, "denial_code": 0b1110, "total": 0b1111}


def report_blocks(stg_with_recovery: DataFrame, seed: DataFrame) -> dict[str, DataFrame]:
    """The five blocks of the denial-trend report (KPI, by month, by payer,
    by specialty, by denial code) from ONE scan: a single aggregate over
    GROUPING SETS ((month), (payer), (specialty), (code), ()), checkpointed
    (it has one row per group) and split by ``grouping_id``. Values equal
    :func:`kpi_denial`, :func:`monthly_breakdown`, :func:`payer_breakdown`,
    :func:`specialty_breakdown` and :func:`reason_breakdown`."""
    s = stg_with_recovery
    den, und = F.col("is_denied"), F.col("is_underpaid")
    g = s.groupingSets([[k] for k in BLOCK_KEYS] + [[]], *BLOCK_KEYS).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(den).alias("denied"),
        F.count_if(und).alias("_u"),
        F.sum(F.when(und, F.col("underpayment_gap"))).alias("_under"),
        F.sum("billed_amount").alias("_billed"),
        F.sum("paid_amount").alias("_paid"),
        F.sum(F.when(den, F.col("billed_amount"))).alias("_lost"),
        F.sum(F.when(F.col("category").isNotNull(), F.col("recovery_potential"))).alias("_rec"),
        F.avg(F.col("days_to_resolve").cast("decimal(12,4)")).alias("_days"),
    )
    # One row per month / payer / specialty / code plus the total: checkpoint
    # it (shared folder) so the five blocks read this small result instead of
    # each re-running the scan (column pruning would give each block its own
    # aggregate, defeating exchange reuse).
    return report_blocks_of(g, seed)


def report_blocks_of(g: DataFrame, seed: DataFrame) -> dict[str, DataFrame]:
    """The blocks from grouping-set rows over BLOCK_KEYS (see :func:`report_blocks`)."""
    ensure_checkpoint_dir(g.sparkSession)
    g = g.checkpoint(eager=True)
    rate = rpt(pct("denied", "total_claims"), 1).alias("denial_rate_pct")

    def block(key, with_paid=False):
        cols = [key, F.col("total_claims").cast("bigint").alias("total_claims"),
                F.col("denied").cast("bigint").alias("denied"),
                F.coalesce(F.round("_under", 2), F.lit(0)).cast("double").alias("underpaid_amt"),
                F.round("_billed", 2).cast("double").alias("billed")]
        if with_paid:
            cols.append(F.round("_paid", 2).cast("double").alias("paid"))
        return g.filter(F.col("_gid") == _GID[key]).select(*cols, rate)

    labels = seed.select("denial_code", F.col("denial_reason_label").alias("label"))
    reason = (
        g.filter((F.col("_gid") == _GID["denial_code"]) & (F.col("denied") > 0))
        .join(labels, "denial_code", "left")
        .select("denial_code", F.col("denied").cast("bigint").alias("claim_count"),
                F.round("_lost", 2).cast("double").alias("billed_lost"), "label")
    )
    total = g.filter(F.col("_gid") == _GID["total"])
    kpi = total.select(
        F.col("total_claims").cast("bigint").alias("total_claims"),
        F.coalesce(F.round("_billed", 0), F.lit(0)).cast("double").alias("total_billed"),
        F.coalesce(F.round("_paid", 0), F.lit(0)).cast("double").alias("total_paid"),
        rpt(pct("denied", "total_claims"), 1).alias("denial_rate"),
        rpt(pct("_u", "total_claims"), 1).alias("underpay_rate"),
        F.coalesce(F.round("_rec", 0), F.lit(0)).cast("double").alias("total_recoverable"),
        rpt("_days", 1).alias("avg_days_to_resolve"),
    )
    return {
        "kpi": kpi,
        "monthly": block("claim_month"),
        "by_payer": block("payer", with_paid=True),
        "by_specialty": block("specialty"),
        "by_reason": reason,
    }
