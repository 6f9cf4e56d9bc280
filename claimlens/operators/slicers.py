"""report slicers from one cube.

Every slicer (payer, specialty, period) has an "all" state besides its
values. One CUBE over the three adds the claims up for all combinations;
``grouping_id`` tells "all" from a missing value. Measures are sums and counts, and
rates are made from them last, so a slice needs no claims. The cube is written
with a folder per combination of "all" states, sorted by its keys: a slice
reads one folder and there the row groups that can hold its keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.rounding import pct, rpt

KEYS = ["payer", "specialty", "period"]
ALL = object()  # the "all" state of a slicer; None is the slice of rows without a value


def fiscal_period(date: str | Column, first_month: int = 7) -> Column:
    """The twelve months that a date lies in, as text ("1997-07 1998-06")."""
    c = F.col(date) if isinstance(date, str) else date
    start = F.add_months(F.trunc(F.add_months(c, 1 - first_month), "year"), first_month - 1)
    return F.concat_ws(" ", F.date_format(start, "yyyy-MM"), F.date_format(F.add_months(start, 11), "yyyy-MM"))


def period_bounds(period: str) -> tuple[dt.date, dt.date]:
    """First day, and the day after the last, of a period."""
    a, b = (dt.date.fromisoformat(f"{x}-01") for x in period.split(" "))
    return a, dt.date(b.year + b.month // 12, b.month % 12 + 1, 1)


def slice_cube(claims: DataFrame, by_month: bool = False) -> DataFrame:
    """The cube of ``recovery.with_recovery`` rows: one row per combination of
    slicer states (and month), with ``slicers`` (bit per slicer, set when it is
    "all": payer 4, specialty 2, period 1)."""
    rows = claims.withColumn("period", fiscal_period("claim_date")).withColumn("_days", F.col("days_to_resolve").cast("decimal(12,4)"))
    den, und, opp = F.col("is_denied"), F.col("is_underpaid"), F.col("category").isNotNull()
    measures = [
        F.count(F.lit(1)).alias("claims"), F.count_if(den).alias("denied"), F.count_if(und).alias("underpaid"), F.sum(F.when(und, F.col("underpayment_gap"))).alias("gap"),
        F.sum("billed_amount").alias("billed"), F.sum("paid_amount").alias("paid"), F.sum(F.when(den, F.col("billed_amount"))).alias("lost"),
        F.sum(F.when(opp, F.col("recovery_potential"))).alias("recoverable"), F.sum("_days").alias("days"), F.count("_days").alias("resolved"),
    ]
    month = ["claim_month"] if by_month else []
    # claims are first added up at the finest grain, so that a claim is not copied for each of the eight combinations
    fine = rows.groupBy(*KEYS, *month).agg(*measures)
    names = ["claims", "denied", "underpaid", "gap", "billed", "paid", "lost", "recoverable", "days", "resolved"]
    sets = [[k for j, k in enumerate(KEYS) if not code >> (2 - j) & 1] + month for code in range(8)]
    g = fine.groupingSets(sets, *KEYS, *month).agg(F.grouping_id().alias("_gid"), *[F.sum(m).alias(m) for m in names])
    return g.withColumn("slicers", F.shiftright("_gid", len(month)).cast("int")).drop("_gid")


def write_cube(cube: DataFrame, path: str) -> DataFrame:
    """The cube by combination of "all" states, sorted by its keys; a reader on it."""
    cube.repartition("slicers").sortWithinPartitions("slicers", *KEYS).write.partitionBy("slicers").parquet(path)
    return cube.sparkSession.read.schema(cube.schema).parquet(path)


def slice_of(cube: DataFrame, payer=ALL, specialty=ALL, period=ALL) -> DataFrame:
    """The cube's rows of one slice: each slicer is ALL, a value, or None
    (rows that have none). No row where no claim is in the slice."""
    state = {"payer": payer, "specialty": specialty, "period": period}
    code = sum(1 << (2 - j) for j, k in enumerate(KEYS) if state[k] is ALL)
    out = cube.filter(F.col("slicers") == code)
    for k, v in state.items():
        if v is not ALL:
            out = out.filter(F.col(k).eqNullSafe(F.lit(v)) if v is not None else F.col(k).isNull())
    return out


def kpis(rows: DataFrame) -> DataFrame:
    """The KPI strip of each slice row: counts, whole dollars, rates in percent."""
    whole = lambda c: F.coalesce(F.round(c, 0), F.lit(0)).cast("double")
    return rows.select(
        "slicers", *KEYS, F.col("claims").alias("total_claims"), whole("billed").alias("total_billed"), whole("paid").alias("total_paid"),
        rpt(pct("denied", "claims"), 1).alias("denial_rate"), rpt(pct("underpaid", "claims"), 1).alias("underpay_rate"),
        whole("recoverable").alias("total_recoverable"), rpt(F.try_divide("days", "resolved").cast("decimal(16,8)"), 1).alias("avg_days_to_resolve"))


def trend(monthly: DataFrame) -> DataFrame:
    """Month rows of a slice, or of several that share no claim (a cube by month): the rate and its change."""
    from claimlens.operators.denials import trend_from_counts

    return trend_from_counts(monthly.groupBy("claim_month").agg(F.sum("claims").alias("n"), F.sum("denied").alias("d")))
