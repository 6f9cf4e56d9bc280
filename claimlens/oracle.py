"""Independent DuckDB SQL for every registered query (the correctness oracle).

The driver registers the warehouse tables as views (orders, customer, nation,
region, ...). Every statement starts from the same claim derivation, written
here in plain SQL, and computes its product without any Spark code.
Rounding rule on both sides: ratios via DECIMAL(24,6), money in decimal.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-02'"

CLAIMS_CTE = f"""
base AS (
  SELECT
    o.o_orderkey AS k,
    o.o_custkey AS cust,
    CAST(o.o_orderdate AS DATE) AS claim_date,
    CAST(n.n_nationkey AS INTEGER) AS payer_id,
    n.n_name AS payer,
    c.c_mktsegment AS specialty,
    CAST(o.o_totalprice AS DECIMAL(12,2)) AS billed_amount,
    CAST(0.60 + 0.04 * ((n.n_nationkey * 5 + length(c.c_mktsegment)) % 8) AS DECIMAL(4,2)) AS expected_rate,
    (o.o_orderkey * 7919 + o.o_custkey * 104729) % 200 AS h
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
raw AS (
  SELECT
    concat('CLM-', CAST(1000000000 + k AS VARCHAR)) AS claim_id,
    claim_date, payer_id, payer, specialty, billed_amount, expected_rate, cust AS submitted_by, k,
    CASE WHEN h < 35 THEN 'Denied' WHEN h < 63 THEN 'Paid - Underpaid'
         WHEN h < 76 THEN 'Pending' ELSE 'Paid' END AS status,
    CAST(round(billed_amount * expected_rate, 2) AS DECIMAL(12,2)) AS full_pay,
    CAST(round(billed_amount * CAST(expected_rate * CAST(0.70 + 0.01 * (k % 20) AS DECIMAL(4,2)) AS DECIMAL(8,4)), 2)
         AS DECIMAL(12,2)) AS under_pay,
    CAST((k * 31 + payer_id) % 8 AS INTEGER) AS code_idx,
    CAST(3 + (k * 13 + payer_id) % 97 AS INTEGER) AS days
  FROM base
),
claims AS (
  SELECT
    claim_id, claim_date, payer_id, payer, specialty, billed_amount,
    CASE WHEN status = 'Paid' THEN full_pay WHEN status = 'Paid - Underpaid' THEN under_pay
         ELSE CAST(0 AS DECIMAL(12,2)) END AS paid_amount,
    status,
    CASE WHEN status = 'Denied' THEN
      CASE code_idx WHEN 0 THEN 'CO-11' WHEN 1 THEN 'CO-16' WHEN 2 THEN 'CO-22' WHEN 3 THEN 'CO-29'
                    WHEN 4 THEN 'CO-45' WHEN 5 THEN 'CO-50' WHEN 6 THEN 'CO-97' ELSE 'PR-1' END
    END AS denial_code,
    CASE WHEN status = 'Denied' THEN
      CASE code_idx WHEN 0 THEN 'Diagnosis/procedure mismatch' WHEN 1 THEN 'Missing claim information'
                    WHEN 2 THEN 'Coordination of benefits' WHEN 3 THEN 'Filing deadline expired'
                    WHEN 4 THEN 'Exceeds contracted rate' WHEN 5 THEN 'Non-covered service'
                    WHEN 6 THEN 'Bundled into another service' ELSE 'Patient deductible' END
    END AS denial_reason,
    CASE WHEN status <> 'Pending' THEN days END AS days_to_resolve,
    CASE WHEN status = 'Paid - Underpaid' THEN CAST(full_pay - under_pay AS DECIMAL(12,2)) END AS underpayment_gap,
    expected_rate, submitted_by
  FROM raw
),
stg AS (
  SELECT
    claim_id, claim_date,
    CAST(date_trunc('month', claim_date) AS DATE) AS claim_month,
    payer, specialty, billed_amount, paid_amount, status, denial_code, denial_reason,
    CAST(days_to_resolve AS DOUBLE) AS days_to_resolve,
    underpayment_gap,
    status = 'Denied' AS is_denied,
    status = 'Paid - Underpaid' AS is_underpaid,
    status IN ('Pending', 'Denied') AS is_open_ar,
    payer_id
  FROM claims
),
warehouse AS (
  SELECT claim_id, payer_id, payer, specialty, claim_date, billed_amount, paid_amount, expected_rate,
         if(status = 'Paid - Underpaid', 'Paid', status) AS claim_status
  FROM claims
),
payers AS (
  SELECT CAST(n_nationkey AS INTEGER) AS payer_id, n_name AS payer_name FROM nation
),
seed(denial_code, denial_reason_label, appeal_success_rate) AS (
  VALUES ('CO-11', 'Diagnosis/procedure mismatch', 0.40),
         ('CO-16', 'Missing claim information', 0.55),
         ('CO-22', 'Coordination of benefits', 0.45),
         ('CO-29', 'Filing deadline expired', 0.05),
         ('CO-45', 'Exceeds contracted rate', 0.65),
         ('CO-50', 'Non-covered service', 0.28),
         ('CO-97', 'Bundled into another service', 0.35),
         ('PR-1', 'Patient deductible', 0.00)
)"""


def with_claims(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the claim derivation (and optional extra CTEs)."""
    ctes = CLAIMS_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


def r(expr: str, n: int = 1) -> str:
    """Report rounding: via DECIMAL(24,6), as DOUBLE."""
    return f"CAST(round(CAST({expr} AS DECIMAL(24,6)), {n}) AS DOUBLE)"


def rd(expr: str, n: int = 1) -> str:
    """Rounding via DECIMAL(24,6), kept DECIMAL."""
    return f"round(CAST({expr} AS DECIMAL(24,6)), {n})"


# --- shared CTE fragments -------------------------------------------------------

BUCKET_CASE = """CASE WHEN {d} <= 30 THEN '0-30' WHEN {d} <= 60 THEN '31-60'
            WHEN {d} <= 90 THEN '61-90' ELSE '90+' END"""

# ages and the label of each bucket, as a table: the smallest and the largest age in days
OPEN_AR = f"""
edges(youngest, oldest, aging_bucket) AS (
  VALUES (-100000, 30, '0-30'), (31, 60, '31-60'), (61, 90, '61-90'), (91, 100000, '90+')
),
oarb AS (
  SELECT s.payer, s.billed_amount, e.aging_bucket
  FROM stg s
  JOIN edges e
    ON CAST(coalesce(s.days_to_resolve, {AS_OF} - s.claim_date) AS INTEGER) BETWEEN e.youngest AND e.oldest
  WHERE s.is_open_ar
)"""

# an opportunity is an underpaid claim, or a denied one whose code has a chance above 0
OPP = """
opp AS (
  SELECT s.claim_id, s.claim_date, s.payer, s.specialty, s.billed_amount, s.paid_amount,
         if(s.is_underpaid, 'Underpayment', 'Denial appeal') AS category,
         if(s.is_underpaid, 'Exceeds contracted rate', k.denial_reason_label) AS reason,
         round(if(s.is_underpaid, CAST(s.underpayment_gap AS DECIMAL(18,6)),
                  CAST(s.billed_amount * CAST(k.appeal_success_rate AS DECIMAL(6,4)) AS DECIMAL(18,6))), 2) AS recovery_potential,
         CASE WHEN s.is_underpaid OR k.appeal_success_rate >= 0.50 THEN 'High'
              WHEN k.appeal_success_rate < 0.25 THEN 'Low' ELSE 'Medium' END AS recovery_confidence,
         if(s.is_underpaid, 'Resubmit for rate correction', 'File appeal') AS recommended_action
  FROM stg s LEFT JOIN seed k USING (denial_code)
  WHERE s.is_underpaid OR (s.is_denied AND coalesce(k.appeal_success_rate, 0) > 0)
)"""

# (weight, metric): lower is better for each
_METRICS = [("0.35", "denial_rate_pct"), ("0.25", "underpay_rate_pct"), ("0.20", "avg_days_to_resolve"), ("0.20", "pct_ar_90plus")]

# one conditional aggregate per payer; the extremes of each metric in a one-row relation; points; order
SCORE = f"""
metrics AS (
  SELECT payer, count(*) AS total_claims, round(sum(billed_amount), 0) AS total_billed, round(sum(paid_amount), 0) AS total_paid,
         {rd("100.0 * sum(CAST(is_denied AS INTEGER)) / count(*)")} AS denial_rate_pct,
         {rd("100.0 * sum(CAST(is_underpaid AS INTEGER)) / count(*)")} AS underpay_rate_pct,
         {rd("avg(days_to_resolve)")} AS avg_days_to_resolve,
         {rd(f"100.0 * sum(CASE WHEN is_open_ar AND coalesce(days_to_resolve, {AS_OF} - claim_date) > 90 THEN 1 ELSE 0 END) / sum(CAST(is_open_ar AS INTEGER))")}
           AS pct_ar_90plus
  FROM stg GROUP BY payer HAVING bool_or(is_open_ar)
),
extremes AS (
  SELECT {", ".join(f"min({m}) AS lo_{i}, max({m}) AS hi_{i}" for i, (_, m) in enumerate(_METRICS))} FROM metrics
),
points AS (
  SELECT m.*, {rd("100 * (" + " + ".join(f"{w} * (hi_{i} - {m}) / nullif(hi_{i} - lo_{i}, 0)" for i, (w, m) in enumerate(_METRICS)) + ")")} AS score
  FROM metrics m, extremes
),
scorecard AS (
  SELECT CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, denial_rate_pct NULLS LAST, payer) AS BIGINT) AS payer_rank, payer,
         coalesce((SELECT min(g) FROM (VALUES ('A', 80), ('B', 65), ('C', 50)) AS grades(g, least) WHERE score >= least), 'D') AS grade,
         CAST(score AS DOUBLE) AS composite_score, CAST(denial_rate_pct AS DOUBLE) AS denial_rate_pct,
         CAST(underpay_rate_pct AS DOUBLE) AS underpay_rate_pct, CAST(avg_days_to_resolve AS DOUBLE) AS avg_days_to_resolve,
         CAST(pct_ar_90plus AS DOUBLE) AS pct_ar_90plus, CAST(total_claims AS BIGINT) AS total_claims,
         CAST(total_billed AS DOUBLE) AS total_billed, CAST(total_paid AS DOUBLE) AS total_paid
  FROM points
)"""

TENANT = """
records AS (
  SELECT CAST(payer_id % 5 AS INTEGER) AS org_id, claim_id AS external_ref, claim_date AS service_date,
         concat('9000', CAST(1 + length(claim_id || specialty) % 4 AS VARCHAR)) AS procedure_code,
         payer AS insurer_name, billed_amount AS charge_amount, paid_amount AS remit_amount,
         CASE WHEN status IN ('Paid', 'Paid - Underpaid') THEN 'paid' WHEN status = 'Denied' THEN 'denied'
              ELSE 'pending' END AS record_status,
         denial_code AS adjustment_code,
         claim_date + CAST(days_to_resolve AS INTEGER) AS decision_date,
         submitted_by
  FROM claims
),
users AS (
  SELECT c_custkey AS user_id, CAST(c_custkey % 5 AS INTEGER) AS org_id,
         lower(replace(c_name, '#', '.')) || '@example.org' AS email,
         CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' ELSE 'viewer' END AS user_role
  FROM customer
),
orgs AS (
  SELECT CAST(r_regionkey AS INTEGER) AS org_id, r_name AS org_name FROM region
)"""
