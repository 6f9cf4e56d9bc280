"""Report-shaping operators over report-sized frames: N2 share-of-max bars,
B5-B8 bands, and X13/X15-X17 labels.

These run over aggregates (one row per payer / month / specialty); the
whole-frame ``max() over ()`` therefore touches a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions import bands, fmt
from claimlens.functions.rounding import rpt


def bar_scale(df: DataFrame, value: str, out: str = "bar_pct") -> DataFrame:
    """``value / max(value) * 100`` (1 dp); NULL when the max is 0."""
    mx = F.max(value).over(Window.partitionBy())
    return df.withColumn(
        out, rpt(F.try_divide(F.col(value).cast("decimal(24,6)") * F.lit(100), F.when(mx != 0, mx).cast("decimal(24,6)")), 1)
    )


def scorecard_bands(scorecard: DataFrame, matrix: DataFrame) -> DataFrame:
    """B7 + B8 per payer: score band, 90+ heat by claim rate and by dollar
    share (left join: the scorecard's payers, zeros when no aging row)."""
    m = matrix.select("payer", F.col("pct_90plus").alias("_share_pct"))
    j = scorecard.join(m, "payer", "left")
    share = F.coalesce(F.col("_share_pct"), F.lit(0.0)) / F.lit(100)
    return j.select(
        "payer",
        bands.score_band("composite_score").alias("score_band"),
        bands.heat_by_rate("pct_ar_90plus").alias("heat_rate"),
        bands.heat_by_share(share).alias("heat_share"),
    )


def labels(df: DataFrame, month: str, money: str, rate: str) -> DataFrame:
    """X15-X17 + X19 in one projection: month label/key/parsed key and the
    money and percent texts of each row."""
    return df.select(
        month,
        fmt.month_label(month).alias("month_label"),
        fmt.month_key(month).alias("month_key"),
        fmt.month_from_key(fmt.month_key(month)).alias("month_parsed"),
        fmt.money_text(money).alias("money_text"),
        fmt.money_k_text(money).alias("money_k_text"),
        fmt.pct_text(rate).alias("pct_text"),
    )
