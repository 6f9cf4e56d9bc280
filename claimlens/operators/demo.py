"""The demo dashboard's products over tenant claim records
(insurer_name, service_date, charge_amount, remit_amount, record_status).

These use the *decided* basis (paid + denied) for denial rates, unlike the
marts, which divide by every submitted claim. NULL group keys are dropped
(the dashboard's grouping drops them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.dates import month_start
from claimlens.functions.rounding import pct, rpt

DECIDED = ["paid", "denied"]


def _decided(records: DataFrame) -> DataFrame:
    return records.filter(F.col("record_status").isin(*DECIDED))


def _denied_share(n_denied, n) -> F.Column:
    return rpt(pct(n_denied, n), 2)


def insurer_denial_rate(records: DataFrame) -> DataFrame:
    """Denial rate per insurer among decided claims, lowest first."""
    g = _decided(records).filter(F.col("insurer_name").isNotNull()).groupBy("insurer_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("record_status") == "denied").alias("d")
    )
    return g.select("insurer_name", _denied_share("d", "n").alias("denial_rate_pct")).orderBy(
        "denial_rate_pct", "insurer_name"
    )


def monthly_denial_decided(records: DataFrame) -> DataFrame:
    """Monthly denial rate among decided claims."""
    g = (
        _decided(records)
        .filter(F.col("service_date").isNotNull())
        .groupBy(month_start("service_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("record_status") == "denied").alias("d"))
    )
    return g.select("month", _denied_share("d", "n").alias("denial_rate_pct")).orderBy("month")


def charged_vs_remitted(records: DataFrame) -> DataFrame:
    """Charged and remitted dollars per month (all claims)."""
    g = (
        records.filter(F.col("service_date").isNotNull())
        .groupBy(month_start("service_date").alias("month"))
        .agg(F.sum("charge_amount").alias("c"), F.sum("remit_amount").alias("r"))
    )
    return g.select(
        "month",
        F.round("c", 2).cast("double").alias("charge_amount"),
        F.round("r", 2).cast("double").alias("remit_amount"),
    ).orderBy("month")


def demo_kpi(records: DataFrame) -> DataFrame:
    """Claims, charged, remitted, denial % (decided basis; 0.0 when
    nothing is decided)."""
    g = records.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("charge_amount").alias("c"),
        F.sum("remit_amount").alias("r"),
        F.count_if(F.col("record_status").isin(*DECIDED)).alias("dec"),
        F.count_if(F.col("record_status") == "denied").alias("d"),
    )
    return g.select(
        F.col("n").cast("bigint").alias("claims"),
        F.coalesce(F.round("c", 2), F.lit(0)).cast("double").alias("charged"),
        F.coalesce(F.round("r", 2), F.lit(0)).cast("double").alias("remitted"),
        F.coalesce(_denied_share("d", "dec"), F.lit(0.0)).alias("denial_pct"),
    )


def listing(records: DataFrame, limit: int | None = None) -> DataFrame:
    """K7: records ordered by service date (a display limit is optional)."""
    out = records.orderBy("service_date", "external_ref")
    return out.limit(limit) if limit else out
