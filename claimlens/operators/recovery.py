"""Revenue recovery: G5 (underpayment detection), G10 (ranked recovery
opportunities), G18 (summary), G19 (breakdowns), G20 (top-k list).

Scale notes:
- G10's two branches (underpaid claims; appealable denials) are disjoint by
  status, so the union is computed in ONE pass: the open claims are joined to
  the 8-row appeal-rate table (a local relation with exact size statistics,
  so Catalyst broadcasts it) and each row picks its branch.
- The opportunity rank is a global ``row_number``; it is computed with
  :func:`claimlens.operators.ranking.distributed_row_number` (range
  partitions + broadcast offsets), never with a single-partition window.
- Top-k uses ``orderBy().limit(k)`` which plans as TakeOrderedAndProject: a
  per-partition top-k and a k-row merge.
- G5 is a join to the rate table in both forms; ``underpayment_lookup`` keeps the
  scalar subquery's rule that a claim may find one rate at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.functions.bands import confidence
from claimlens.functions.rounding import MONEY
from claimlens.operators.lookup import scalar_lookup
from claimlens.operators.ranking import distributed_row_number

SEED_SCHEMA = "denial_code string, denial_reason_label string, appeal_success_rate double"

OPPORTUNITY_COLUMNS = [
    "claim_id",
    "claim_date",
    "payer",
    "specialty",
    "category",
    "reason",
    "billed_amount",
    "paid_amount",
    "recovery_potential",
    "recovery_confidence",
    "recommended_action",
]


def appeal_rates(spark: SparkSession) -> DataFrame:
    """The appeal-success-rate seed as a SQL ``VALUES`` local relation: its
    exact size statistics let Catalyst broadcast it to every join (a frame
    made with ``createDataFrame`` from a list carries no statistics and would
    be planned as a sort-merge join that shuffles the claims)."""
    rows = ", ".join(
        f"('{code}', '{label}', CAST({rate} AS DOUBLE))" for code, label, rate in P.APPEAL_SUCCESS_RATES
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS seed(denial_code, denial_reason_label, appeal_success_rate)")


def with_recovery(stg: DataFrame, seed: DataFrame) -> DataFrame:
    """Every staged claim plus the opportunity columns (NULL ``category`` for
    claims that are not opportunities).

    Underpaid claims: recovery = the gap (2 dp), confidence High.
    Denied claims whose code has a rate > 0: recovery = billed x rate rounded
    per claim (2 dp, in decimal), confidence by rate. Unknown codes and rate 0
    are not opportunities."""
    rates = seed.select(
        "denial_code",
        F.col("denial_reason_label").alias("_label"),
        F.col("appeal_success_rate").cast("decimal(6,4)").alias("_rate"),
    )
    j = stg.join(rates, "denial_code", "left")
    under = F.col("is_underpaid")
    appeal = F.col("is_denied") & (F.col("_rate") > 0)
    return j.select(
        *stg.columns,
        F.when(under, P.CATEGORY_UNDERPAYMENT).when(appeal, P.CATEGORY_APPEAL).alias("category"),
        F.when(under, F.lit(P.UNDERPAYMENT_REASON)).when(appeal, F.col("_label")).alias("reason"),
        F.when(under, F.round(F.col("underpayment_gap"), 2))
        .when(appeal, F.round(F.col("billed_amount") * F.col("_rate"), 2))
        .cast(MONEY)
        .alias("recovery_potential"),
        F.when(under, F.lit(P.UNDERPAYMENT_CONFIDENCE)).when(appeal, confidence("_rate")).alias("recovery_confidence"),
        F.when(under, F.lit(P.ACTION_RESUBMIT)).when(appeal, F.lit(P.ACTION_APPEAL)).alias("recommended_action"),
    )


def opportunities(stg: DataFrame, seed: DataFrame) -> DataFrame:
    """Unranked recovery opportunities (the union of both branches)."""
    open_claims = stg.filter(F.col("is_underpaid") | F.col("is_denied"))
    return with_recovery(open_claims, seed).filter(F.col("category").isNotNull()).select(*OPPORTUNITY_COLUMNS)


def rank_order():
    """Largest recovery first; ties by claim id (a total order)."""
    return [F.desc_nulls_last("recovery_potential"), F.asc("claim_id")]


def _report(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c).cast("double").alias(c) if c in ("billed_amount", "paid_amount", "recovery_potential") else F.col(c)
          for c in df.columns]
    )


def recovery_opportunities(stg: DataFrame, seed: DataFrame) -> DataFrame:
    """Every opportunity with its global rank (ties: claim_id).

    Rows come in rank order without another sort: they were sorted once for
    the rank, and the checkpointed partitions hold consecutive ranks."""
    ranked = distributed_row_number(opportunities(stg, seed), rank_order(), "opportunity_rank")
    return _report(ranked.select(F.col("opportunity_rank").cast("bigint"), *OPPORTUNITY_COLUMNS))


def top_opportunities(stg: DataFrame, seed: DataFrame, k: int = 25) -> DataFrame:
    """The k largest opportunities in the published top-list shape."""
    top = opportunities(stg, seed).orderBy(*rank_order()).limit(k)
    # rank within k rows: a k-row window, after the distributed top-k
    from pyspark.sql import Window

    return _top_shape(top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())).cast("bigint")))


def top_of(mart: DataFrame, k: int = 25) -> DataFrame:
    """G20 from the written G10 mart, whose rank says which rows they are."""
    return _top_shape(mart.filter(F.col("opportunity_rank") <= k).withColumn("rank", F.col("opportunity_rank")))


def _top_shape(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "claim_id",
        "claim_date",
        "payer",
        "specialty",
        "category",
        "reason",
        F.col("billed_amount").cast("double").alias("billed"),
        F.col("paid_amount").cast("double").alias("current_paid"),
        F.col("recovery_potential").cast("double").alias("recovery_potential"),
        "recovery_confidence",
        F.col("recommended_action").alias("action"),
        "rank",
    )


def recovery_summary(stg: DataFrame, seed: DataFrame) -> DataFrame:
    """One row, dollars rounded to whole units as published, plus the
    billed universe (all claims). One pass over the claims."""
    s = with_recovery(stg, seed)
    rec = F.col("recovery_potential")
    is_opp = F.col("category").isNotNull()
    g = s.agg(
        F.sum(F.when(is_opp, rec)).alias("t"),
        F.sum(F.when(is_opp & (F.col("recovery_confidence") == "High"), rec)).alias("h"),
        F.sum(F.when(F.col("category") == P.CATEGORY_UNDERPAYMENT, rec)).alias("u"),
        F.sum(F.when(F.col("category") == P.CATEGORY_APPEAL, rec)).alias("a"),
        F.count_if(is_opp).alias("n"),
        F.sum("billed_amount").alias("b"),
    )
    z = lambda c: F.coalesce(F.round(c, 0), F.lit(0)).cast("double")
    return g.select(
        z("t").alias("total_recovery_potential"),
        z("h").alias("high_confidence_recovery"),
        z("u").alias("underpayment_recovery"),
        z("a").alias("appeal_recovery"),
        F.col("n").cast("bigint").alias("n_opportunities"),
        z("b").alias("total_billed_universe"),
    )


def recovery_by(stg: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Recovery dollars and opportunity count per key(s), largest first."""
    o = opportunities(stg, seed)
    g = o.groupBy(*keys).agg(F.sum("recovery_potential").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select(
        *keys,
        F.round("s", 2).cast("double").alias("recovery_potential"),
        F.col("n").cast("bigint").alias("claim_count"),
    ).orderBy(F.desc("recovery_potential"), *keys)


# --- G5 ------------------------------------------------------------------------------

def underpayment_detection(claims: DataFrame, expected_rates: DataFrame, tolerance: float = 0.95) -> DataFrame:
    """G5 (join form): paid claims whose payment is below ``tolerance`` x the
    contracted amount, with the rate and the gap, largest gap first.

    ``claims`` is in warehouse form: claim_id, payer_id, specialty,
    billed_amount, paid_amount, status, where an underpaid claim is plainly
    ``Paid``: underpayment is found here, not read from a label.
    A duplicated (payer_id, specialty) rate would duplicate claims: run
    ``quality.unique_failures`` on the rate table first.
    """
    tol = F.lit(str(tolerance)).cast("decimal(6,4)")
    rates = expected_rates.select("payer_id", "specialty", F.col("expected_rate").cast("decimal(6,4)").alias("expected_rate"))
    c = claims.filter(F.col("status") == P.STATUS_PAID).select(
        "claim_id", "payer_id", "specialty", F.col("billed_amount").cast(MONEY).alias("billed_amount"),
        F.col("paid_amount").cast(MONEY).alias("paid_amount"),
    )
    j = c.join(rates, ["payer_id", "specialty"])
    contracted = F.col("expected_rate") * F.col("billed_amount")
    flagged = j.filter(F.col("paid_amount") < contracted * tol)
    return flagged.select(
        "claim_id",
        "payer_id",
        F.col("billed_amount").cast("double").alias("billed_amount"),
        F.col("paid_amount").cast("double").alias("paid_amount"),
        F.col("expected_rate").cast("double").alias("expected_rate"),
        F.round(contracted - F.col("paid_amount"), 2).cast("double").alias("underpayment_gap"),
    ).orderBy(F.desc("underpayment_gap"), "claim_id")


def underpayment_lookup(claims: DataFrame, expected_rates: DataFrame, tolerance: float = 0.95) -> DataFrame:
    """G5 as first asked: a paid claim's rate is the ONE contracted rate of its
    payer and specialty. Equal to :func:`underpayment_detection` where every
    rate is single; a claim with two rates fails the query instead of
    coming out twice, and one without a rate is not underpaid."""
    tol = F.lit(str(tolerance)).cast("decimal(6,4)")
    rates = expected_rates.select("payer_id", "specialty", F.col("expected_rate").cast("decimal(6,4)").alias("expected_rate"))
    paid = claims.filter(F.col("status") == P.STATUS_PAID).select(
        "claim_id", "payer_id", "specialty", F.col("billed_amount").cast(MONEY).alias("billed_amount"),
        F.col("paid_amount").cast(MONEY).alias("paid_amount"),
    )
    found = scalar_lookup(paid, rates, ["payer_id", "specialty"], ["expected_rate"], what="contracted rate", required=True)
    contracted = F.col("expected_rate") * F.col("billed_amount")
    return found.filter(F.col("paid_amount") < contracted * tol).select(
        "claim_id",
        "payer_id",
        F.col("billed_amount").cast("double").alias("billed_amount"),
        F.col("paid_amount").cast("double").alias("paid_amount"),
        F.col("expected_rate").cast("double").alias("expected_rate"),
        F.round(contracted - F.col("paid_amount"), 2).cast("double").alias("underpayment_gap"),
    ).orderBy(F.desc("underpayment_gap"), "claim_id")


def recovery_ratios(stg: DataFrame, seed: DataFrame) -> DataFrame:
    """Recoverable dollars as % of all billed, and the high-confidence
    share of the recoverable dollars (one pass over the claims)."""
    from claimlens.functions.rounding import rpt

    s = with_recovery(stg, seed)
    rec = F.when(F.col("category").isNotNull(), F.col("recovery_potential"))
    g = s.agg(
        F.sum(rec).alias("r"),
        F.sum(F.when(F.col("recovery_confidence") == "High", rec)).alias("h"),
        F.sum("billed_amount").alias("b"),
    )
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    return g.select(
        rpt(F.try_divide(F.col("r") * F.lit(100), nz("b")), 2).alias("recovery_pct_of_billed"),
        rpt(F.try_divide(F.col("h") * F.lit(100), nz("r")), 2).alias("high_confidence_share_pct"),
    )


REC_KEYS = ["payer", "specialty", "category", "reason"]
# grouping_id per set: one bit per key, set when the key is NOT grouped
_REC_GID = {"payer": 0b0111, "specialty": 0b1011, "reason": 0b1100, "total": 0b1111}


def recovery_blocks(stg: DataFrame, seed: DataFrame) -> dict[str, DataFrame]:
    """G18 + G19 from ONE scan: an aggregate over GROUPING SETS ((payer),
    (specialty), (category, reason), ()) of every claim with its opportunity
    columns (measures count only opportunities; the billed universe counts
    all claims), checkpointed (one row per group) and split by
    ``grouping_id``. Equal to :func:`recovery_summary` and :func:`recovery_by`."""
    s = with_recovery(stg, seed)
    opp = F.col("category").isNotNull()
    rec = F.when(opp, F.col("recovery_potential"))
    g = s.groupingSets([["payer"], ["specialty"], ["category", "reason"], []], *REC_KEYS).agg(
        F.grouping_id().alias("_gid"),
        F.sum(rec).alias("_s"),
        F.count_if(opp).alias("_n"),
        F.sum(F.when(opp & (F.col("recovery_confidence") == "High"), F.col("recovery_potential"))).alias("_h"),
        F.sum(F.when(F.col("category") == P.CATEGORY_UNDERPAYMENT, F.col("recovery_potential"))).alias("_u"),
        F.sum(F.when(F.col("category") == P.CATEGORY_APPEAL, F.col("recovery_potential"))).alias("_a"),
        F.sum("billed_amount").alias("_b"),
    )
    return recovery_blocks_of(g)


def recovery_blocks_of(g: DataFrame) -> dict[str, DataFrame]:
    """The blocks from grouping-set rows over REC_KEYS (see :func:`recovery_blocks`)."""
    from claimlens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(g.sparkSession)
    g = g.checkpoint(eager=True)
    gid = F.col("_gid")

    def by(keys, code):
        return g.filter((gid == code) & (F.col("_n") > 0)).select(
            *keys,
            F.round("_s", 2).cast("double").alias("recovery_potential"),
            F.col("_n").cast("bigint").alias("claim_count"),
        )

    z = lambda c: F.coalesce(F.round(c, 0), F.lit(0)).cast("double")
    summary = g.filter(gid == _REC_GID["total"]).select(
        z("_s").alias("total_recovery_potential"),
        z("_h").alias("high_confidence_recovery"),
        z("_u").alias("underpayment_recovery"),
        z("_a").alias("appeal_recovery"),
        F.col("_n").cast("bigint").alias("n_opportunities"),
        z("_b").alias("total_billed_universe"),
    )
    return {
        "summary": summary,
        "by_payer": by(["payer"], _REC_GID["payer"]),
        "by_specialty": by(["specialty"], _REC_GID["specialty"]),
        "by_reason": by(["category", "reason"], _REC_GID["reason"]),
    }
