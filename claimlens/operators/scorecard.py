"""G9 payer scorecard (N1 weighted min-max composite, B3 grade, W3/W4) and
N4 radar axes.

Plan shape: ONE scan of the claims and ONE partial+final aggregate by payer
produce every per-payer measure, including the open-AR counts the published
model obtains by joining claims to a separate AR aggregate (claim-grain join
avoided). Payers with no open AR are dropped, as that inner join does. The
normalisation windows (``max/min over ()``) and the rank then run over the
payer-grain frame only (one row per payer).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.functions.bands import aging_bucket, grade
from claimlens.functions.rounding import int_days, pct, rnd
from claimlens.operators.aging import ar_age

METRICS = ["denial_rate_pct", "underpay_rate_pct", "avg_days_to_resolve", "pct_ar_90plus"]


def payer_aggregates(as_of: dt.date) -> list:
    """The per-payer aggregate expressions (also usable in grouping sets)."""
    age = ar_age(as_of, "decision")
    open_ar = F.col("is_open_ar")
    return [
        F.count(F.lit(1)).alias("total_claims"),
        F.sum("billed_amount").alias("_billed"),
        F.sum("paid_amount").alias("_paid"),
        F.count_if(F.col("is_denied")).alias("_d"),
        F.count_if(F.col("is_underpaid")).alias("_u"),
        F.avg(F.col("days_to_resolve").cast("decimal(12,4)")).alias("_days"),  # decimal: the order of a sum cannot move it
        F.count_if(open_ar).alias("ar_claims"),
        F.count_if(open_ar & (age > 90)).alias("ar_claims_90plus"),
        F.sum(F.when(open_ar, F.col("billed_amount"))).alias("ar_billed"),
        F.sum(F.when(open_ar & (aging_bucket(int_days(age)) == P.AGING_BUCKETS[-1]), F.col("billed_amount"))).alias(
            "ar_billed_90plus"
        ),
    ]


def per_payer(stg: DataFrame, as_of: dt.date) -> DataFrame:
    """Per-payer metrics, each rounded to 1 dp *before* normalisation."""
    return per_payer_from(stg.groupBy("payer").agg(*payer_aggregates(as_of)))


def per_payer_from(g: DataFrame) -> DataFrame:
    """Per-payer metrics from the :func:`payer_aggregates` columns; payers
    without open AR are dropped."""
    return g.filter(F.col("ar_claims") > 0).select(
        "payer",
        "total_claims",
        F.round("_billed", 0).alias("total_billed"),
        F.round("_paid", 0).alias("total_paid"),
        rnd(pct("_d", "total_claims"), 1).alias("denial_rate_pct"),
        rnd(pct("_u", "total_claims"), 1).alias("underpay_rate_pct"),
        rnd("_days", 1).alias("avg_days_to_resolve"),
        rnd(pct("ar_claims_90plus", "ar_claims"), 1).alias("pct_ar_90plus"),
        "ar_billed",
        F.coalesce("ar_billed_90plus", F.lit(0).cast("decimal(22,2)")).alias("ar_billed_90plus"),
    )


def score(per: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weighted min-max composite (lower is better for every metric), the
    grade and the rank on the *rounded* score (ties: lower denial rate, then
    payer name). A metric with max == min makes the composite NULL (grade D).

    ``per`` has one row per payer; the un-partitioned windows run over it."""
    weights = weights or P.SCORE_WEIGHTS
    whole = Window.partitionBy()
    terms = []
    for m in METRICS:
        hi = F.max(m).over(whole)
        lo = F.min(m).over(whole)
        w = F.lit(str(weights[m])).cast("decimal(6,4)")
        terms.append(w * (hi - F.col(m)) / F.nullif(hi - lo, F.lit(0)))
    composite = F.lit(100) * (terms[0] + terms[1] + terms[2] + terms[3])
    scored = per.withColumn("_score", rnd(composite, 1))
    rank_w = Window.orderBy(F.desc_nulls_last("_score"), F.asc_nulls_last("denial_rate_pct"), F.asc_nulls_last("payer"))
    return scored.withColumn("payer_rank", F.row_number().over(rank_w)).withColumn("grade", grade("_score"))


def scorecard_frame(stg: DataFrame, as_of: dt.date, weights: dict | None = None) -> DataFrame:
    """Per-payer frame with metrics, score, grade, rank and AR dollars."""
    return score(per_payer(stg, as_of), weights)


def payer_scorecard(stg: DataFrame, as_of: dt.date, weights: dict | None = None) -> DataFrame:
    """The scorecard mart."""
    return scorecard_report(scorecard_frame(stg, as_of, weights))


def scorecard_report(s: DataFrame) -> DataFrame:
    """The published columns of a scored per-payer frame, by rank."""
    return s.select(
        F.col("payer_rank").cast("bigint").alias("payer_rank"),
        "payer",
        "grade",
        F.col("_score").cast("double").alias("composite_score"),
        *[F.col(m).cast("double").alias(m) for m in METRICS],
        F.col("total_claims").cast("bigint").alias("total_claims"),
        F.col("total_billed").cast("double").alias("total_billed"),
        F.col("total_paid").cast("double").alias("total_paid"),
    ).orderBy("payer_rank")


def score_published(metrics: DataFrame, weights: dict | None = None) -> DataFrame:
    """Score step alone, from already-published 1-dp metrics
    (payer + the four METRICS columns)."""
    per = metrics.select("payer", *[F.col(m).cast("decimal(10,1)").alias(m) for m in METRICS])
    s = score(per, weights)
    return s.select(
        F.col("payer_rank").cast("bigint").alias("payer_rank"),
        "payer",
        "grade",
        F.col("_score").cast("double").alias("composite_score"),
    )


def radar_axes(scorecard: DataFrame, top: int = 4) -> DataFrame:
    """The four radar axes of the ``top`` best-ranked payers."""
    s = scorecard.filter(F.col("payer_rank") <= top)
    d = lambda c: F.col(c).cast("decimal(10,1)")
    return s.select(
        "payer_rank",
        "payer",
        (F.lit(100) - F.lit(4) * d("denial_rate_pct")).cast("double").alias("axis_denial"),
        (F.lit(100) - F.lit(4) * d("underpay_rate_pct")).cast("double").alias("axis_underpay"),
        (F.lit(100) - F.lit(10) * (d("avg_days_to_resolve") - F.lit(15))).cast("double").alias("axis_speed"),
        (F.lit(100) - F.lit(2) * d("pct_ar_90plus")).cast("double").alias("axis_aging"),
    )
