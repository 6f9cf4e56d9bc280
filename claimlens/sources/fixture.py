"""Claims and tenant tables derived from the driver's warehouse tables.

One claim per ``orders`` row, joined to ``customer`` (specialty) and
``nation`` (payer). Only integer and decimal arithmetic is used, so the same
derivation written in another SQL engine yields identical rows.

Scale notes: ``orders ⋈ customer`` is the only large join; no hint is given,
so Catalyst broadcasts ``customer`` only while its measured size is under the
broadcast threshold and otherwise plans a sort-merge join, whose skewed
partitions (one customer holding a large share of orders) AQE splits.
``nation`` is a 25-row dimension and is broadcast by size statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.sources import tables

# --- FIXED VALUES of the derivation (hash multipliers and thresholds) ------
CLAIM_ID_BASE = 1_000_000_000
STATUS_HASH = (7919, 104729, 200)  # (orderkey mult, custkey mult, modulus)
STATUS_CUTS = [(35, P.STATUS_DENIED), (63, P.STATUS_UNDERPAID), (76, P.STATUS_PENDING)]  # else Paid
DENIAL_HASH = (31, 8)
DAYS_HASH = (13, 97, 3)  # (orderkey mult, modulus, offset)


def _expected_rate(nationkey: Column, segment: Column) -> Column:
    step = ((nationkey * 5 + F.length(segment)) % 8).cast("int")
    return (F.lit(0.60).cast("decimal(3,2)") + F.lit(0.04).cast("decimal(3,2)") * step).cast("decimal(4,2)")


def _status(k: Column, cust: Column) -> Column:
    a, b, m = STATUS_HASH
    h = (k * a + cust * b) % m
    expr = None
    for cut, label in STATUS_CUTS:
        expr = F.when(h < cut, label) if expr is None else expr.when(h < cut, label)
    return expr.otherwise(P.STATUS_PAID)


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claim extract (the landing table): one row per order.

    Columns: claim_id, claim_date, payer_id, payer, specialty, billed_amount,
    paid_amount, status, denial_code, denial_reason, days_to_resolve,
    underpayment_gap, expected_rate, submitted_by.
    """
    o = tables.orders(spark, sf_dir)
    c = tables.customer(spark, sf_dir).select("c_custkey", "c_nationkey", "c_mktsegment")
    n = tables.nation(spark, sf_dir).select("n_nationkey", "n_name")

    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))

    k = F.col("o_orderkey")
    payer_id = F.col("n_nationkey")
    billed = F.col("o_totalprice").cast("decimal(12,2)")
    rate = _expected_rate(payer_id, F.col("c_mktsegment"))
    status = _status(k, F.col("o_custkey"))
    full_pay = F.round(billed * rate, 2).cast("decimal(12,2)")
    under_factor = (F.lit(0.70).cast("decimal(3,2)") + F.lit(0.01).cast("decimal(3,2)") * (k % 20)).cast("decimal(4,2)")
    under_pay = F.round(billed * (rate * under_factor).cast("decimal(8,4)"), 2).cast("decimal(12,2)")

    codes = F.array(*[F.lit(code) for code, _, _ in P.APPEAL_SUCCESS_RATES])
    labels = F.array(*[F.lit(label) for _, label, _ in P.APPEAL_SUCCESS_RATES])
    dm, dmod = DENIAL_HASH
    code_idx = F.pmod(k * dm + payer_id, F.lit(dmod)).cast("int") + 1
    tm, tmod, toff = DAYS_HASH

    base = j.select(
        F.concat(F.lit("CLM-"), (F.lit(CLAIM_ID_BASE) + k).cast("string")).alias("claim_id"),
        F.col("o_orderdate").cast("date").alias("claim_date"),
        payer_id.cast("int").alias("payer_id"),
        F.col("n_name").alias("payer"),
        F.col("c_mktsegment").alias("specialty"),
        billed.alias("billed_amount"),
        status.alias("status"),
        rate.alias("expected_rate"),
        full_pay.alias("_full_pay"),
        under_pay.alias("_under_pay"),
        code_idx.alias("_code_idx"),
        (F.lit(toff) + (k * tm + payer_id) % tmod).cast("int").alias("_days"),
        F.col("o_custkey").alias("submitted_by"),
    )
    st = F.col("status")
    return base.select(
        "claim_id",
        "claim_date",
        "payer_id",
        "payer",
        "specialty",
        "billed_amount",
        F.when(st == P.STATUS_PAID, F.col("_full_pay"))
        .when(st == P.STATUS_UNDERPAID, F.col("_under_pay"))
        .otherwise(F.lit(0).cast("decimal(12,2)"))
        .alias("paid_amount"),
        "status",
        F.when(st == P.STATUS_DENIED, F.element_at(codes, F.col("_code_idx"))).alias("denial_code"),
        F.when(st == P.STATUS_DENIED, F.element_at(labels, F.col("_code_idx"))).alias("denial_reason"),
        F.when(st != P.STATUS_PENDING, F.col("_days")).alias("days_to_resolve"),
        F.when(st == P.STATUS_UNDERPAID, (F.col("_full_pay") - F.col("_under_pay")).cast("decimal(12,2)")).alias(
            "underpayment_gap"
        ),
        "expected_rate",
        "submitted_by",
    )


def payers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payer dimension (payer_id, payer_name)."""
    return tables.nation(spark, sf_dir).select(
        F.col("n_nationkey").cast("int").alias("payer_id"), F.col("n_name").alias("payer_name")
    )


def expected_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracted rate per (payer_id, specialty).

    Derived from ``customer ⋈ nation`` rather than from the claims: it is a
    function of (nation, segment) only, and the distinct runs with a partial
    aggregate per input partition, so the shuffle carries at most
    (#payers x #specialties) rows per map task.
    """
    c = tables.customer(spark, sf_dir).select("c_nationkey", "c_mktsegment").distinct()
    n = tables.nation(spark, sf_dir).select("n_nationkey")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("n_nationkey").cast("int").alias("payer_id"),
        F.col("c_mktsegment").alias("specialty"),
        _expected_rate(F.col("n_nationkey"), F.col("c_mktsegment")).alias("expected_rate"),
    )


# --- tenant store --------------------------------------------------------------

def _record_status(status: Column) -> Column:
    return (
        F.when(status.isin(P.STATUS_PAID, P.STATUS_UNDERPAID), "paid")
        .when(status == P.STATUS_DENIED, "denied")
        .otherwise("pending")
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizations (tenants): one per region."""
    return tables.region(spark, sf_dir).select(
        F.col("r_regionkey").cast("int").alias("org_id"), F.col("r_name").alias("org_name")
    )


def app_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer: org = custkey % 5, role = custkey % 3."""
    c = tables.customer(spark, sf_dir).select("c_custkey", "c_name")
    roles = F.array(*[F.lit(r) for r in P.ROLES])
    return c.select(
        F.col("c_custkey").alias("user_id"),
        (F.col("c_custkey") % 5).cast("int").alias("org_id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.org")).alias("email"),
        F.element_at(roles, F.pmod(F.col("c_custkey"), F.lit(3)).cast("int") + 1).alias("user_role"),
    )


def claim_records_from(claims: DataFrame) -> DataFrame:
    """Tenant claim records derived from raw (or staged) claims; the
    adjustment code is the denial code and the decision date is the claim
    date plus the days to resolve (NULL while pending)."""
    return claims.select(
        (F.col("payer_id") % 5).cast("int").alias("org_id"),
        F.col("claim_id").alias("external_ref"),
        F.col("claim_date").alias("service_date"),
        F.concat(F.lit("9000"), (F.lit(1) + F.length(F.concat("claim_id", "specialty")) % 4).cast("string")).alias(
            "procedure_code"
        ),
        F.col("payer").alias("insurer_name"),
        F.col("billed_amount").cast("decimal(12,2)").alias("charge_amount"),
        F.col("paid_amount").cast("decimal(12,2)").alias("remit_amount"),
        _record_status(F.col("status")).alias("record_status"),
        F.col("denial_code").alias("adjustment_code"),
        F.date_add(F.col("claim_date"), F.col("days_to_resolve").cast("int")).alias("decision_date"),
        F.col("submitted_by"),
    )


def claim_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_records_from(raw_claims(spark, sf_dir))
