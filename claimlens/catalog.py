"""Registry of the data products: name -> (Spark query, DuckDB oracle SQL).

Each Spark query is ``(spark, sf_dir) -> DataFrame`` and reads the warehouse
tables of ``sf_dir`` in full (through the staged claims table that the first
product of a session writes, see :func:`stg`). ``oracle`` is the independent
DuckDB SQL of the product (every registered product has one).
"""

from __future__ import annotations

import threading
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlens import oracle as O
from claimlens.params import Params
from claimlens.sources import fixture, tables
from claimlens.operators import staging

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Product:
    name: str
    fn: QueryFn
    oracle: str | None
    ids: str  # inventory ids covered


REGISTRY: dict[str, Product] = {}


def product(name: str, ids: str, oracle: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Product(name, fn, oracle, ids)
        return fn

    return deco


PARAMS = Params()


_REFS: dict = {}
_LOCK = threading.RLock()


def ref(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Model reference: each relation is declared once per session and input
    folder, and later products reuse the same DataFrame (a lazy plan, or for
    the staged claims a reader on the table written once). The names, sizes
    and times of the input's files are part of the key, so changed input is
    read anew; :func:`forget` drops relations by hand."""
    try:
        session_key = spark.sparkContext.applicationId
    except Exception:  # sessions without a SparkContext handle
        session_key = id(spark)
    key = (session_key, sf_dir.rstrip("/"), name, _input_state(spark, sf_dir))
    with _LOCK:  # two threads never build the same relation twice
        if key not in _REFS:
            _REFS[key] = build()
        return _REFS[key]


def _input_state(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with the files of the warehouse tables (two folder levels)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    found = []
    for top in fs.listStatus(path):
        table = top.getPath().getName().removesuffix(".parquet")
        if table in tables.SCHEMAS:
            files = fs.listStatus(top.getPath()) if top.isDirectory() else [top]
            found += [(table, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files]
    return hash(tuple(sorted(found)))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref(spark, sf_dir, "raw_claims", lambda: fixture.raw_claims(spark, sf_dir))


def stg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged claims, materialised once per session and input folder as a
    month-partitioned parquet table in the shared checkpoint folder; every
    product reads that table (lineage cut, no re-join of the warehouse
    tables per product, month filters prune folders). It carries
    ``payer_id`` and ``submitted_by`` besides the staged columns."""
    from claimlens.plans.build import stage_to_table
    from claimlens.sinks.publish import new_scratch

    return ref(spark, sf_dir, "stg_claims", lambda: stage_to_table(
        raw(spark, sf_dir), new_scratch(spark, "stg_claims"), keep=("payer_id", "submitted_by")))


def wh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse-form claims: as staged, but underpaid claims are plainly paid."""
    from pyspark.sql import functions as F

    from claimlens import params as P

    paid = F.when(F.col("status") == P.STATUS_UNDERPAID, P.STATUS_PAID).otherwise(F.col("status"))
    return stg(spark, sf_dir).withColumn("status", paid)


def forget(sf_dir: str | None = None) -> None:
    """Drop the declared relations (of one input folder, or all), so that
    changed input is read anew."""
    with _LOCK:
        for key in [k for k in _REFS if sf_dir is None or k[1] == sf_dir.rstrip("/")]:
            del _REFS[key]


def seed(spark: SparkSession) -> DataFrame:
    return recovery.appeal_rates(spark)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref(spark, sf_dir, "claim_records", lambda: fixture.claim_records_from(stg(spark, sf_dir)))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref(spark, sf_dir, "app_users", lambda: fixture.app_users(spark, sf_dir))


def payers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref(spark, sf_dir, "payers", lambda: fixture.payers(spark, sf_dir))


from claimlens.operators import aging, demo, denials, quality, recovery, reports, scorecard, tenant  # noqa: E402

A = PARAMS.as_of
TENANT_USER = 1  # the user whose scoped reads are reported

# ---------------------------------------------------------------------------
# G1 staging

@product("stg_claims", "G1 S8 S9 P3 P4 K1", O.with_claims("""
SELECT claim_id, claim_date, claim_month, payer, specialty,
       CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(paid_amount AS DOUBLE) AS paid_amount,
       status, denial_code, denial_reason, days_to_resolve,
       CAST(underpayment_gap AS DOUBLE) AS underpayment_gap, is_denied, is_underpaid, is_open_ar
FROM stg"""))
def q_stg_claims(spark, sf_dir):
    return staging.report_view(stg(spark, sf_dir))


# ---------------------------------------------------------------------------
# warehouse-form queries

@product("denial_rate_by_payer_12m", "G2 F1 A1 A2 J1 J2 A7 O1", O.with_claims(f"""
SELECT p.payer_name,
       CAST(sum(s.n) AS BIGINT) AS total_claims,
       CAST(sum(s.d) AS BIGINT) AS denied_claims,
       {O.r("100.0 * sum(s.d) / sum(s.n)")} AS denial_rate_pct
FROM (SELECT payer_id, count(*) AS n, sum(CASE WHEN status = 'Denied' THEN 1 ELSE 0 END) AS d
      FROM claims WHERE claim_date >= {O.AS_OF} - INTERVAL 12 MONTH GROUP BY payer_id) s
JOIN payers p ON s.payer_id = p.payer_id
GROUP BY p.payer_name"""))
def q_denial_rate_by_payer_12m(spark, sf_dir):
    return denials.denial_rate_by_payer(wh(spark, sf_dir), payers(spark, sf_dir), A, PARAMS.trailing_months)


@product("ar_aging_claims", "G3 F3 X3 B1", O.with_claims(f"""
SELECT claim_id, payer_id, CAST(billed_amount AS DOUBLE) AS billed_amount,
       CAST(date_diff('day', claim_date, {O.AS_OF}) AS INTEGER) AS days_outstanding,
       {O.BUCKET_CASE.format(d=f"date_diff('day', claim_date, {O.AS_OF})")} AS aging_bucket
FROM claims WHERE status IN ('Pending', 'Denied')"""))
def q_ar_aging_claims(spark, sf_dir):
    return aging.ar_aging_claims(wh(spark, sf_dir), A)


@product("ar_aging_submission", "G4 J1 A10 O2", O.with_claims(f"""
SELECT p.payer_name, b.aging_bucket, CAST(count(*) AS BIGINT) AS claim_count,
       CAST(round(sum(b.billed_amount), 2) AS DOUBLE) AS billed_in_bucket
FROM (SELECT payer_id, billed_amount,
             {O.BUCKET_CASE.format(d=f"date_diff('day', claim_date, {O.AS_OF})")} AS aging_bucket
      FROM claims WHERE status IN ('Pending', 'Denied')) b
JOIN payers p ON b.payer_id = p.payer_id
GROUP BY p.payer_name, b.aging_bucket"""))
def q_ar_aging_submission(spark, sf_dir):
    return aging.ar_aging_by_payer(wh(spark, sf_dir), payers(spark, sf_dir), A)


@product("underpayment_detection", "G5 J3 J4 J5 F5 X8", O.with_claims("""
SELECT c.claim_id, c.payer_id, CAST(c.billed_amount AS DOUBLE) AS billed_amount,
       CAST(c.paid_amount AS DOUBLE) AS paid_amount, CAST(er.expected_rate AS DOUBLE) AS expected_rate,
       CAST(round(c.billed_amount * er.expected_rate - c.paid_amount, 2) AS DOUBLE) AS underpayment_gap
FROM warehouse c
JOIN (SELECT DISTINCT payer_id, specialty, expected_rate FROM claims) er USING (payer_id, specialty)
WHERE c.claim_status = 'Paid' AND c.paid_amount < (er.expected_rate * c.billed_amount) * 0.95"""))
def q_underpayment_detection(spark, sf_dir):
    claims = wh(spark, sf_dir)
    return recovery.underpayment_detection(claims, fixture.expected_rates(spark, sf_dir), PARAMS.underpayment_tolerance)


@product("monthly_trend_raw", "G6 A11 A2 W1", O.with_claims(f"""
SELECT claim_month, CAST(total_claims AS BIGINT) AS total_claims, CAST(denied_claims AS BIGINT) AS denied_claims,
       {O.r("denied_claims * 100.0 / total_claims")} AS denial_rate_pct,
       {O.r("denied_claims * 100.0 / total_claims - lag(denied_claims * 100.0 / total_claims) OVER (ORDER BY claim_month)")}
         AS pct_change_vs_prior_month
FROM (SELECT CAST(date_trunc('month', claim_date) AS DATE) AS claim_month, count(*) AS total_claims,
             sum(CASE WHEN status = 'Denied' THEN 1 ELSE 0 END) AS denied_claims
      FROM claims GROUP BY 1)"""))
def q_monthly_trend_raw(spark, sf_dir):
    return denials.monthly_trend_raw(stg(spark, sf_dir))


# ---------------------------------------------------------------------------
# marts (G7-G10)

@product("monthly_denial_trend", "G7 A3 A7 W2", O.with_claims(f"""
SELECT claim_month,
       CAST(n AS BIGINT) AS claims_submitted,
       CAST(d AS BIGINT) AS denied_claims,
       CAST(rate AS DOUBLE) AS denial_rate_pct,
       CAST(lag(rate) OVER (ORDER BY claim_month) AS DOUBLE) AS prior_month_rate_pct,
       {O.r("rate - lag(rate) OVER (ORDER BY claim_month)")} AS mom_change_pts
FROM (
  SELECT claim_month, n, d, {O.rd("100.0 * d / n")} AS rate
  FROM (SELECT claim_month, count(*) AS n, count(*) FILTER (WHERE is_denied) AS d FROM stg GROUP BY claim_month)
)"""))
def q_monthly_denial_trend(spark, sf_dir):
    return denials.monthly_denial_trend(stg(spark, sf_dir))


@product("ar_aging_decision", "G8 F4 X6 X3 X1 B1 B2 A10", O.with_claims("""
SELECT payer, aging_bucket,
       CASE aging_bucket WHEN '0-30' THEN 1 WHEN '31-60' THEN 2 WHEN '61-90' THEN 3 ELSE 4 END AS bucket_order,
       CAST(count(*) AS BIGINT) AS claim_count,
       CAST(round(sum(billed_amount), 2) AS DOUBLE) AS billed_in_bucket
FROM oarb GROUP BY payer, aging_bucket""", O.OPEN_AR))
def q_ar_aging_decision(spark, sf_dir):
    return aging.ar_aging(stg(spark, sf_dir), A, "decision")


@product("payer_scorecard", "G9 N1 W3 W4 B3 A3 A6 J8", O.with_claims("SELECT * FROM scorecard", O.SCORE))
def q_payer_scorecard(spark, sf_dir):
    return scorecard.payer_scorecard(stg(spark, sf_dir), A)


@product("recovery_opportunities", "G10 U1 J9 F6 B4 W5 P5", O.with_claims("""
SELECT CAST(row_number() OVER (ORDER BY recovery_potential DESC NULLS LAST, claim_id) AS BIGINT) AS opportunity_rank,
       claim_id, claim_date, payer, specialty, category, reason,
       CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(paid_amount AS DOUBLE) AS paid_amount,
       CAST(recovery_potential AS DOUBLE) AS recovery_potential, recovery_confidence, recommended_action
FROM opp""", O.OPP))
def q_recovery_opportunities(spark, sf_dir):
    return recovery.recovery_opportunities(stg(spark, sf_dir), seed(spark))


# ---------------------------------------------------------------------------
# report products

@product("kpi_denial", "G11 A9", O.with_claims(f"""
SELECT CAST(count(*) AS BIGINT) AS total_claims,
       CAST(coalesce(round(sum(billed_amount), 0), 0) AS DOUBLE) AS total_billed,
       CAST(coalesce(round(sum(paid_amount), 0), 0) AS DOUBLE) AS total_paid,
       {O.r("100.0 * count(*) FILTER (WHERE is_denied) / count(*)")} AS denial_rate,
       {O.r("100.0 * count(*) FILTER (WHERE is_underpaid) / count(*)")} AS underpay_rate,
       (SELECT CAST(coalesce(round(sum(recovery_potential), 0), 0) AS DOUBLE) FROM opp) AS total_recoverable,
       {O.r("avg(days_to_resolve)")} AS avg_days_to_resolve
FROM stg""", O.OPP))
def q_kpi_denial(spark, sf_dir):
    return denials.kpi_denial(recovery.with_recovery(stg(spark, sf_dir), seed(spark)))


def _breakdown_sql(key: str, with_paid: bool, extra: str = "") -> str:
    paid = "CAST(round(sum(paid_amount), 2) AS DOUBLE) AS paid," if with_paid else ""
    return O.with_claims(f"""
SELECT {key}, CAST(total_claims AS BIGINT) AS total_claims, CAST(denied AS BIGINT) AS denied,
       underpaid_amt, billed, {"paid," if with_paid else ""} denial_rate_pct {extra}
FROM (
  SELECT {key}, count(*) AS total_claims, count(*) FILTER (WHERE is_denied) AS denied,
         CAST(coalesce(round(sum(underpayment_gap) FILTER (WHERE is_underpaid), 2), 0) AS DOUBLE) AS underpaid_amt,
         CAST(round(sum(billed_amount), 2) AS DOUBLE) AS billed, {paid}
         {O.r("100.0 * count(*) FILTER (WHERE is_denied) / count(*)")} AS denial_rate_pct
  FROM stg GROUP BY {key})""")


@product("monthly_breakdown", "G12 A11 A4 A5", _breakdown_sql("claim_month", False))
def q_monthly_breakdown(spark, sf_dir):
    return denials.monthly_breakdown(stg(spark, sf_dir))


@product("payer_breakdown", "G13 A3 A5 A7 B6 O8", _breakdown_sql("payer", True, ", denial_rate_pct >= 18 AS flagged"))
def q_payer_breakdown(spark, sf_dir):
    b = denials.payer_breakdown(stg(spark, sf_dir))
    return b.withColumn("flagged", reports.bands.payer_flag("denial_rate_pct"))


@product("specialty_breakdown", "G15 B5", _breakdown_sql(
    "specialty", False,
    ", CASE WHEN denial_rate_pct >= 19 THEN 'high' WHEN denial_rate_pct >= 17 THEN 'mid' ELSE 'low' END AS severity"))
def q_specialty_breakdown(spark, sf_dir):
    return denials.specialty_breakdown(stg(spark, sf_dir))


@product("reason_breakdown", "G14 F4 J9 A1 A5", O.with_claims("""
SELECT d.denial_code, CAST(d.n AS BIGINT) AS claim_count, CAST(round(d.lost, 2) AS DOUBLE) AS billed_lost,
       s.denial_reason_label AS label
FROM (SELECT denial_code, count(*) AS n, sum(billed_amount) AS lost FROM stg WHERE is_denied GROUP BY denial_code) d
LEFT JOIN seed s ON s.denial_code = d.denial_code"""))
def q_reason_breakdown(spark, sf_dir):
    return denials.reason_breakdown(stg(spark, sf_dir), seed(spark))


@product("ar_summary", "G16 A9 A16 O7", O.with_claims(f"""
SELECT CAST(coalesce(round((SELECT sum(billed_amount) FROM oarb), 0), 0) AS DOUBLE) AS total_ar_outstanding,
       CAST(coalesce(round((SELECT sum(billed_amount) FROM oarb WHERE aging_bucket = '90+'), 0), 0) AS DOUBLE)
         AS ar_90plus,
       {O.r("100.0 * (SELECT sum(billed_amount) FROM oarb WHERE aging_bucket = '90+') / nullif((SELECT sum(billed_amount) FROM oarb), 0)")}
         AS ar_90plus_pct,
       CAST(count(*) AS BIGINT) AS n_payers,
       arg_min(payer, payer_rank) AS best_payer,
       arg_max(payer, payer_rank) AS worst_payer
FROM scorecard""", O.SCORE + "," + O.OPEN_AR))
def q_ar_summary(spark, sf_dir):
    return aging.ar_summary(scorecard.scorecard_frame(stg(spark, sf_dir), A))


@product("ar_aging_matrix", "G17 A15 A14 N3 J12", O.with_claims(f"""
SELECT payer,
       CAST(round(coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '0-30'), 0), 2) AS DOUBLE) AS bucket_0_30,
       CAST(round(coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '31-60'), 0), 2) AS DOUBLE) AS bucket_31_60,
       CAST(round(coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '61-90'), 0), 2) AS DOUBLE) AS bucket_61_90,
       CAST(round(coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '90+'), 0), 2) AS DOUBLE) AS bucket_90_plus,
       CAST(round(sum(billed_amount), 2) AS DOUBLE) AS total,
       {O.r("100.0 * coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '90+'), 0) / nullif(sum(billed_amount), 0)")}
         AS pct_90plus
FROM oarb GROUP BY payer""", O.OPEN_AR))
def q_ar_aging_matrix(spark, sf_dir):
    return aging.ar_aging_matrix(stg(spark, sf_dir), A)


@product("recovery_summary", "G18 A4 A9 N5", O.with_claims("""
SELECT CAST(coalesce(round(sum(recovery_potential), 0), 0) AS DOUBLE) AS total_recovery_potential,
       CAST(coalesce(round(sum(recovery_potential) FILTER (WHERE recovery_confidence = 'High'), 0), 0) AS DOUBLE)
         AS high_confidence_recovery,
       CAST(coalesce(round(sum(recovery_potential) FILTER (WHERE category = 'Underpayment'), 0), 0) AS DOUBLE)
         AS underpayment_recovery,
       CAST(coalesce(round(sum(recovery_potential) FILTER (WHERE category = 'Denial appeal'), 0), 0) AS DOUBLE)
         AS appeal_recovery,
       CAST(count(*) AS BIGINT) AS n_opportunities,
       (SELECT CAST(coalesce(round(sum(billed_amount), 0), 0) AS DOUBLE) FROM stg) AS total_billed_universe
FROM opp""", O.OPP))
def q_recovery_summary(spark, sf_dir):
    return recovery.recovery_summary(stg(spark, sf_dir), seed(spark))


def _recovery_by_sql(keys: str) -> str:
    return O.with_claims(f"""
SELECT {keys}, CAST(round(sum(recovery_potential), 2) AS DOUBLE) AS recovery_potential,
       CAST(count(*) AS BIGINT) AS claim_count
FROM opp GROUP BY {keys}""", O.OPP)


@product("recovery_by_payer", "G19 A5 O8", _recovery_by_sql("payer"))
def q_recovery_by_payer(spark, sf_dir):
    return recovery.recovery_by(stg(spark, sf_dir), seed(spark), ["payer"])


@product("recovery_by_specialty", "G19 A5 O8", _recovery_by_sql("specialty"))
def q_recovery_by_specialty(spark, sf_dir):
    return recovery.recovery_by(stg(spark, sf_dir), seed(spark), ["specialty"])


@product("recovery_by_reason", "G19 A5 O8 T14", _recovery_by_sql("category, reason"))
def q_recovery_by_reason(spark, sf_dir):
    return recovery.recovery_by(stg(spark, sf_dir), seed(spark), ["category", "reason"])


@product("top25_recovery", "G20 O5", O.with_claims("""
SELECT claim_id, claim_date, payer, specialty, category, reason,
       CAST(billed_amount AS DOUBLE) AS billed, CAST(paid_amount AS DOUBLE) AS current_paid,
       CAST(recovery_potential AS DOUBLE) AS recovery_potential, recovery_confidence,
       recommended_action AS action, CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY recovery_potential DESC NULLS LAST, claim_id) AS rank FROM opp)
WHERE rank <= 25""", O.OPP))
def q_top25_recovery(spark, sf_dir):
    return recovery.top_opportunities(stg(spark, sf_dir), seed(spark), PARAMS.top_k)


# ---------------------------------------------------------------------------
# demo-app products (G21-G24) over tenant claim records

def _decided_rate_sql(key_expr: str, key: str, where: str) -> str:
    return O.with_claims(f"""
SELECT {key_expr} AS {key},
       {O.r("100.0 * count(*) FILTER (WHERE record_status = 'denied') / count(*)", 2)} AS denial_rate_pct
FROM records WHERE record_status IN ('paid', 'denied') AND {where}
GROUP BY 1""", O.TENANT)


@product("insurer_denial_rate", "G21 F3 A8 O4 D2", _decided_rate_sql("insurer_name", "insurer_name", "insurer_name IS NOT NULL"))
def q_insurer_denial_rate(spark, sf_dir):
    return demo.insurer_denial_rate(records(spark, sf_dir))


@product("monthly_denial_decided", "G22 F3 A8 A11 P7", _decided_rate_sql(
    "CAST(date_trunc('month', service_date) AS DATE)", "month", "service_date IS NOT NULL"))
def q_monthly_denial_decided(spark, sf_dir):
    return demo.monthly_denial_decided(records(spark, sf_dir))


@product("charged_vs_remitted", "G23 A12", O.with_claims("""
SELECT CAST(date_trunc('month', service_date) AS DATE) AS month,
       CAST(round(sum(charge_amount), 2) AS DOUBLE) AS charge_amount,
       CAST(round(sum(remit_amount), 2) AS DOUBLE) AS remit_amount
FROM records WHERE service_date IS NOT NULL GROUP BY 1""", O.TENANT))
def q_charged_vs_remitted(spark, sf_dir):
    return demo.charged_vs_remitted(records(spark, sf_dir))


@product("demo_kpi", "G24 A9 T22", O.with_claims(f"""
SELECT CAST(count(*) AS BIGINT) AS claims,
       CAST(coalesce(round(sum(charge_amount), 2), 0) AS DOUBLE) AS charged,
       CAST(coalesce(round(sum(remit_amount), 2), 0) AS DOUBLE) AS remitted,
       coalesce({O.r("100.0 * count(*) FILTER (WHERE record_status = 'denied') / nullif(count(*) FILTER (WHERE record_status IN ('paid', 'denied')), 0)", 2)}, 0.0)
         AS denial_pct
FROM records""", O.TENANT))
def q_demo_kpi(spark, sf_dir):
    return demo.demo_kpi(records(spark, sf_dir))


# ---------------------------------------------------------------------------
# report shaping (F9, N2-N4, B5-B8, labels)

SLICE_SPECIALTY = "AUTOMOBILE"
SLICE_PERIOD = ("1997-01-01", "2000-01-01")


@product("sliced_trend", "F9 G7", O.with_claims(f"""
SELECT claim_month,
       CAST(n AS BIGINT) AS claims_submitted,
       CAST(d AS BIGINT) AS denied_claims,
       CAST(rate AS DOUBLE) AS denial_rate_pct,
       CAST(lag(rate) OVER (ORDER BY claim_month) AS DOUBLE) AS prior_month_rate_pct,
       {O.r("rate - lag(rate) OVER (ORDER BY claim_month)")} AS mom_change_pts
FROM (
  SELECT claim_month, n, d, {O.rd("100.0 * d / n")} AS rate
  FROM (SELECT claim_month, count(*) AS n, count(*) FILTER (WHERE is_denied) AS d FROM stg
        WHERE specialty = '{SLICE_SPECIALTY}'
          AND claim_date >= DATE '{SLICE_PERIOD[0]}' AND claim_date < DATE '{SLICE_PERIOD[1]}'
        GROUP BY claim_month)
)"""))
def q_sliced_trend(spark, sf_dir):
    import datetime as dt

    period = tuple(dt.date.fromisoformat(d) for d in SLICE_PERIOD)
    s = denials.slice_claims(stg(spark, sf_dir), specialty=SLICE_SPECIALTY, period=period)
    return denials.monthly_denial_trend(s)


@product("radar_axes", "N4", O.with_claims("""
SELECT payer_rank, payer,
       CAST(100 - 4 * CAST(denial_rate_pct AS DECIMAL(10,1)) AS DOUBLE) AS axis_denial,
       CAST(100 - 4 * CAST(underpay_rate_pct AS DECIMAL(10,1)) AS DOUBLE) AS axis_underpay,
       CAST(100 - 10 * (CAST(avg_days_to_resolve AS DECIMAL(10,1)) - 15) AS DOUBLE) AS axis_speed,
       CAST(100 - 2 * CAST(pct_ar_90plus AS DECIMAL(10,1)) AS DOUBLE) AS axis_aging
FROM scorecard WHERE payer_rank <= 4""", O.SCORE))
def q_radar_axes(spark, sf_dir):
    return scorecard.radar_axes(scorecard.payer_scorecard(stg(spark, sf_dir), A))


_MATRIX_CTE = O.OPEN_AR + f""",
matrix AS (
  SELECT payer,
       CAST(round(coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '0-30'), 0), 2) AS DOUBLE) AS bucket_0_30,
       CAST(round(coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '31-60'), 0), 2) AS DOUBLE) AS bucket_31_60,
       CAST(round(coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '61-90'), 0), 2) AS DOUBLE) AS bucket_61_90,
       CAST(round(coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '90+'), 0), 2) AS DOUBLE) AS bucket_90_plus,
       CAST(round(sum(billed_amount), 2) AS DOUBLE) AS total,
       {O.r("100.0 * coalesce(sum(billed_amount) FILTER (WHERE aging_bucket = '90+'), 0) / nullif(sum(billed_amount), 0)")}
         AS pct_90plus
  FROM oarb GROUP BY payer
)"""


def _share(c: str) -> str:
    return O.r(f"CAST({c} AS DECIMAL(24,6)) * 100 / CAST(total AS DECIMAL(24,6))")


@product("aging_share", "N3 A14", O.with_claims(f"""
SELECT payer, {_share('bucket_0_30')} AS share_0_30, {_share('bucket_31_60')} AS share_31_60,
       {_share('bucket_61_90')} AS share_61_90, {_share('bucket_90_plus')} AS share_90_plus
FROM matrix WHERE total <> 0""", _MATRIX_CTE))
def q_aging_share(spark, sf_dir):
    return aging.aging_share(aging.ar_aging_matrix(stg(spark, sf_dir), A))


@product("bar_scale", "N2 A13", O.with_claims(f"""
SELECT payer, denial_rate_pct,
       {O.r("CAST(denial_rate_pct AS DECIMAL(24,6)) * 100 / CAST(nullif(max(denial_rate_pct) OVER (), 0) AS DECIMAL(24,6))")}
         AS bar_pct
FROM (SELECT payer, {O.r("100.0 * count(*) FILTER (WHERE is_denied) / count(*)")} AS denial_rate_pct
      FROM stg GROUP BY payer)"""))
def q_bar_scale(spark, sf_dir):
    b = denials.payer_breakdown(stg(spark, sf_dir), ordered=False).select("payer", "denial_rate_pct")
    return reports.bar_scale(b, "denial_rate_pct")


@product("report_bands", "B7 B8 J12", O.with_claims("""
SELECT s.payer,
       CASE WHEN s.composite_score >= 80 THEN 'A' WHEN s.composite_score >= 65 THEN 'B'
            WHEN s.composite_score >= 50 THEN 'C' WHEN s.composite_score >= 35 THEN 'D' ELSE 'F' END AS score_band,
       s.pct_ar_90plus >= 20 AS heat_rate,
       coalesce(m.pct_90plus, 0.0) / 100 >= 0.20 AS heat_share
FROM scorecard s LEFT JOIN matrix m ON m.payer = s.payer""", O.SCORE + "," + _MATRIX_CTE))
def q_report_bands(spark, sf_dir):
    s = stg(spark, sf_dir)
    return reports.scorecard_bands(scorecard.payer_scorecard(s, A), aging.ar_aging_matrix(s, A))


@product("report_labels", "X15 X16 X17 X19", O.with_claims(f"""
SELECT claim_month,
       strftime(claim_month, '%b %y') AS month_label,
       strftime(claim_month, '%Y-%m') AS month_key,
       CAST(strptime(strftime(claim_month, '%Y-%m'), '%Y-%m') AS DATE) AS month_parsed,
       '$' || format('{{:,}}', CAST(round(CAST(billed AS DECIMAL(24,6)), 0) AS BIGINT)) AS money_text,
       '$' || CAST(CAST(round(CAST(billed AS DECIMAL(24,6)) / 1000, 0) AS BIGINT) AS VARCHAR) || 'K' AS money_k_text,
       printf('%.1f', CAST(round(CAST(rate AS DECIMAL(24,6)), 1) AS DOUBLE)) || '%' AS pct_text
FROM (SELECT claim_month, sum(billed_amount) AS billed,
             {O.r("100.0 * count(*) FILTER (WHERE is_denied) / count(*)")} AS rate
      FROM stg GROUP BY claim_month)"""))
def q_report_labels(spark, sf_dir):
    m = denials.monthly_breakdown(stg(spark, sf_dir))
    return reports.labels(m, "claim_month", "billed", "denial_rate_pct")


# ---------------------------------------------------------------------------
# tenant operators (RL1-RL4)

RECORD_COLUMNS = ["org_id", "external_ref", "service_date", "procedure_code", "insurer_name",
                  "charge_amount", "remit_amount", "record_status", "adjustment_code", "decision_date"]
_RECORD_SQL_COLUMNS = """org_id, external_ref, service_date, procedure_code, insurer_name,
       CAST(charge_amount AS DOUBLE) AS charge_amount, CAST(remit_amount AS DOUBLE) AS remit_amount, record_status,
       adjustment_code, decision_date"""


def _records_report(df: DataFrame, extra=()) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(*[F.col(c).cast("double").alias(c) if c.endswith("_amount") else F.col(c)
                       for c in RECORD_COLUMNS + list(extra)])


@product("tenant_read", "RL1 RL2 J7 F8", O.with_claims(f"""
SELECT {_RECORD_SQL_COLUMNS}
FROM records WHERE org_id IN (SELECT org_id FROM users WHERE user_id = {TENANT_USER})""", O.TENANT))
def q_tenant_read(spark, sf_dir):
    app_users = users(spark, sf_dir)
    return _records_report(tenant.scoped_read(records(spark, sf_dir), app_users, TENANT_USER))


@product("tenant_profile", "RL3", O.with_claims(f"""
SELECT user_id, org_id, email, user_role FROM users WHERE user_id = {TENANT_USER}""", O.TENANT))
def q_tenant_profile(spark, sf_dir):
    return tenant.own_profile(users(spark, sf_dir), TENANT_USER)


@product("tenant_visibility", "RL2", O.with_claims("""
SELECT u.user_id, CAST(coalesce(p.n, 0) AS BIGINT) AS visible_records,
       CAST(coalesce(round(p.c, 2), 0) AS DOUBLE) AS visible_charges
FROM users u LEFT JOIN (SELECT org_id, count(*) AS n, sum(charge_amount) AS c FROM records GROUP BY org_id) p
  ON p.org_id = u.org_id""", O.TENANT))
def q_tenant_visibility(spark, sf_dir):
    return tenant.visibility_summary(records(spark, sf_dir), users(spark, sf_dir))


_APPEND_SQL = """
SELECT {cols}, submitted_by
FROM records r
WHERE {neg} EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.submitted_by AND u.org_id = r.org_id
                      AND u.user_role IN ('admin', 'analyst'))"""


@product("tenant_append_accepted", "RL4 K6", O.with_claims(
    _APPEND_SQL.format(cols=_RECORD_SQL_COLUMNS, neg=""), O.TENANT))
def q_tenant_append_accepted(spark, sf_dir):
    return _records_report(tenant.append_accepted(records(spark, sf_dir), users(spark, sf_dir)),
                           ["submitted_by"])


@product("tenant_append_rejected", "RL4 RL5", O.with_claims(
    _APPEND_SQL.format(cols=_RECORD_SQL_COLUMNS, neg="NOT"), O.TENANT))
def q_tenant_append_rejected(spark, sf_dir):
    return _records_report(tenant.append_rejected(records(spark, sf_dir), users(spark, sf_dir)),
                           ["submitted_by"])


@product("tenant_denied_writes", "RL5 RL4", O.with_claims("""
SELECT u.user_id, w.table_name, w.action
FROM users u, (SELECT * FROM (VALUES ('organizations'), ('app_users'), ('claim_records'), ('report_runs')) t(table_name),
                             (VALUES ('insert'), ('update'), ('delete')) a(action)) w
WHERE NOT (w.table_name = 'claim_records' AND w.action = 'insert' AND u.user_role IN ('admin', 'analyst'))""", O.TENANT))
def q_tenant_denied_writes(spark, sf_dir):
    return tenant.denied_writes(users(spark, sf_dir))


APPEND_CUTOFF = "2000-01-01"  # records before it form the store, the rest the incoming batch


@product("tenant_append_validation", "K6 RL4 Q1 Q2 Q3 Q4", O.with_claims(f"""
SELECT reject_reason, CAST(count(*) AS BIGINT) AS n_rows, CAST(round(sum(charge_amount), 2) AS DOUBLE) AS charges
FROM (
  SELECT b.*,
         CASE WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = b.submitted_by AND u.org_id = b.org_id
                                 AND u.user_role IN ('admin', 'analyst')) THEN 'not_writer'
              WHEN b.org_id IS NULL OR b.external_ref IS NULL OR b.service_date IS NULL OR b.procedure_code IS NULL
                   OR b.insurer_name IS NULL OR b.charge_amount IS NULL OR b.record_status IS NULL THEN 'null_field'
              WHEN b.charge_amount < 0 OR coalesce(b.remit_amount, 0) < 0 THEN 'negative_amount'
              WHEN b.record_status NOT IN ('paid', 'denied', 'pending') THEN 'bad_status'
              WHEN EXISTS (SELECT 1 FROM records e WHERE e.service_date < DATE '{APPEND_CUTOFF}'
                      AND e.org_id = b.org_id AND e.external_ref = b.external_ref) THEN 'already_exists'
         END AS reject_reason
  FROM records b WHERE b.service_date >= DATE '{APPEND_CUTOFF}')
GROUP BY reject_reason""", O.TENANT))
def q_tenant_append_validation(spark, sf_dir):
    """Validate every record dated from the cutoff as an incoming batch
    against the store of earlier records (the two parts cover the whole
    table): rows and charges per rejection reason (NULL = accepted)."""
    from pyspark.sql import functions as F

    r = records(spark, sf_dir)
    cutoff = F.lit(APPEND_CUTOFF).cast("date")
    v = tenant.validate_append(r.filter(F.col("service_date") >= cutoff), users(spark, sf_dir),
                               r.filter(F.col("service_date") < cutoff))
    return v.groupBy("reject_reason").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.round(F.sum("charge_amount"), 2).cast("double").alias("charges"),
    )


# ---------------------------------------------------------------------------
# data-quality checks (Q1-Q5) and mart schema tests

def _dq_specs():
    from claimlens import params as P

    return {
        "claims": dict(not_null=["claim_id", "status", "billed_amount", "payer"],
                       accepted={"status": P.STATUSES}, non_negative=["billed_amount", "paid_amount"]),
        "claim_records": dict(not_null=["org_id", "external_ref", "service_date", "procedure_code", "insurer_name",
                                        "charge_amount", "remit_amount", "record_status"],
                              accepted={"record_status": P.RECORD_STATUSES},
                              non_negative=["charge_amount", "remit_amount"]),
        "app_users": dict(not_null=["user_id", "org_id", "email", "user_role"], accepted={"user_role": P.ROLES},
                          non_negative=[]),
    }


_DQ_SQL_SOURCE = {"claims": "stg", "claim_records": "records", "app_users": "users"}


def _dq_sql(check: str) -> str:
    parts = []
    for table, spec in _dq_specs().items():
        src = _DQ_SQL_SOURCE[table]
        if check == "not_null":
            for c in spec["not_null"]:
                parts.append(f"SELECT '{table}' AS table_name, 'not_null' AS \"check\", '{c}' AS column_name, "
                             f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS failures FROM {src}")
        elif check == "accepted_values":
            for c, vals in spec["accepted"].items():
                lst = ", ".join(f"'{v}'" for v in vals)
                parts.append(f"SELECT '{table}' AS table_name, 'accepted_values' AS \"check\", '{c}' AS column_name, "
                             f"CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({lst})) AS BIGINT) AS failures "
                             f"FROM {src}")
        else:
            for c in spec["non_negative"]:
                parts.append(f"SELECT '{table}' AS table_name, 'non_negative' AS \"check\", '{c}' AS column_name, "
                             f"CAST(count(*) FILTER (WHERE {c} < 0) AS BIGINT) AS failures FROM {src}")
    return O.with_claims("\nUNION ALL\n".join(parts), O.TENANT)


def _dq_spark(spark, sf_dir, check: str) -> DataFrame:
    from functools import reduce

    from pyspark.sql import functions as F

    frames = {"claims": stg(spark, sf_dir), "claim_records": records(spark, sf_dir),
              "app_users": users(spark, sf_dir)}
    keys = {"not_null": "not_null", "accepted_values": "accepted", "non_negative": "non_negative"}
    outs = [quality.summary(t, frames[t], **{keys[check]: spec[keys[check]]})
            for t, spec in _dq_specs().items() if spec[keys[check]]]
    return reduce(DataFrame.unionByName, outs)


@product("dq_not_null", "Q2", _dq_sql("not_null"))
def q_dq_not_null(spark, sf_dir):
    return _dq_spark(spark, sf_dir, "not_null")


@product("dq_accepted", "Q3", _dq_sql("accepted_values"))
def q_dq_accepted(spark, sf_dir):
    return _dq_spark(spark, sf_dir, "accepted_values")


@product("dq_range", "Q4", _dq_sql("non_negative"))
def q_dq_range(spark, sf_dir):
    return _dq_spark(spark, sf_dir, "non_negative")


_UNIQUE_CHECKS = [  # (table, key columns, SQL source)
    ("claims", ["claim_id"], "stg"),
    ("claim_records", ["org_id", "external_ref"], "records"),
    ("app_users", ["user_id"], "users"),
    ("app_users", ["email"], "users"),
    ("appeal_success_rates", ["denial_code"], "seed"),
    ("expected_rates", ["payer_id", "specialty"], "(SELECT DISTINCT payer_id, specialty, expected_rate FROM claims)"),
]


@product("dq_unique", "Q1", O.with_claims("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns, CAST(count(*) AS BIGINT) AS duplicate_keys "
    f"FROM (SELECT {', '.join(k)} FROM {src} WHERE {' AND '.join(c + ' IS NOT NULL' for c in k)} "
    f"GROUP BY {', '.join(k)} HAVING count(*) > 1)"
    for t, k, src in _UNIQUE_CHECKS), O.TENANT))
def q_dq_unique(spark, sf_dir):
    from functools import reduce

    from pyspark.sql import functions as F

    frames = {
        "claims": stg(spark, sf_dir),
        "claim_records": records(spark, sf_dir),
        "app_users": users(spark, sf_dir),
        "appeal_success_rates": seed(spark),
        "expected_rates": fixture.expected_rates(spark, sf_dir),
    }
    outs = [
        quality.unique_failures(frames[t], k).agg(F.count(F.lit(1)).alias("duplicate_keys")).select(
            F.lit(t).alias("table_name"), F.lit(",".join(k)).alias("key_columns"),
            F.col("duplicate_keys").cast("bigint"))
        for t, k, _ in _UNIQUE_CHECKS
    ]
    return reduce(DataFrame.unionByName, outs)


@product("dq_foreign_key", "Q5", O.with_claims("""
SELECT 'claim_records' AS table_name, 'org_id' AS column_name,
       CAST(count(*) FILTER (WHERE org_id IS NOT NULL AND org_id NOT IN (SELECT org_id FROM orgs)) AS BIGINT) AS failures
FROM records
UNION ALL
SELECT 'app_users', 'org_id',
       CAST(count(*) FILTER (WHERE org_id IS NOT NULL AND org_id NOT IN (SELECT org_id FROM orgs)) AS BIGINT) FROM users
UNION ALL
SELECT 'claims', 'denial_code',
       CAST(count(*) FILTER (WHERE denial_code IS NOT NULL AND denial_code NOT IN (SELECT denial_code FROM seed)) AS BIGINT)
FROM stg""", O.TENANT))
def q_dq_foreign_key(spark, sf_dir):
    from functools import reduce

    from pyspark.sql import functions as F

    orgs = fixture.organizations(spark, sf_dir)
    checks = [
        ("claim_records", "org_id", records(spark, sf_dir), orgs, "org_id"),
        ("app_users", "org_id", users(spark, sf_dir), orgs, "org_id"),
        ("claims", "denial_code", stg(spark, sf_dir), seed(spark), "denial_code"),
    ]
    outs = [
        quality.foreign_key_failures(child.select(col), parent, col, pk).agg(F.count(F.lit(1)).alias("failures"))
        .select(F.lit(t).alias("table_name"), F.lit(col).alias("column_name"), F.col("failures").cast("bigint"))
        for t, col, child, parent, pk in checks
    ]
    return reduce(DataFrame.unionByName, outs)


# ---------------------------------------------------------------------------
# sources / sinks round trips and consistency checks

@product("claims_csv_roundtrip", "S1 K2 S9", O.with_claims("""
SELECT status, CAST(count(*) AS BIGINT) AS claim_count, CAST(round(sum(billed_amount), 2) AS DOUBLE) AS billed,
       CAST(round(sum(paid_amount), 2) AS DOUBLE) AS paid, CAST(count(days_to_resolve) AS BIGINT) AS decided
FROM stg GROUP BY status"""))
def q_claims_csv_roundtrip(spark, sf_dir):
    from pyspark.sql import functions as F

    from claimlens.sinks.publish import new_scratch
    from claimlens.sources.files import RAW_CLAIMS_SCHEMA, read_raw_claims_csv

    path = new_scratch(spark, "raw_claims_csv")
    # the extract's columns, taken from the staged table (no re-run of the derivation join)
    raw_df = stg(spark, sf_dir).select(*RAW_CLAIMS_SCHEMA.fieldNames())
    raw_df.write.mode("overwrite").option("header", True).csv(path)
    s = staging.stg_claims(read_raw_claims_csv(spark, path))
    return s.groupBy("status").agg(
        F.count(F.lit(1)).cast("bigint").alias("claim_count"),
        F.round(F.sum("billed_amount"), 2).cast("double").alias("billed"),
        F.round(F.sum("paid_amount"), 2).cast("double").alias("paid"),
        F.count("days_to_resolve").cast("bigint").alias("decided"),
    )


def _published_scorecard(spark, sf_dir):
    """Publish the scorecard document (K3) once per session and read it back
    (S3); every consumer reads the same published file."""
    from claimlens.sinks.publish import new_scratch, publish_json, scorecard_document
    from claimlens.sources.files import SCORECARD_DOC_SCHEMA, read_report

    s = stg(spark, sf_dir)

    def publish():
        frame = scorecard.scorecard_frame(s, A)
        doc = scorecard_document(scorecard.payer_scorecard(s, A), aging.ar_aging_matrix(s, A),
                                 aging.ar_summary(frame), A)
        path = publish_json(doc, new_scratch(spark, "scorecard_doc"))
        return read_report(spark, path, SCORECARD_DOC_SCHEMA)

    return s, ref(spark, sf_dir, "scorecard_document", publish)


@product("report_json_roundtrip", "K3 S3 P8 P9", O.with_claims("""
SELECT payer_rank AS rank, payer, grade, composite_score, denial_rate_pct AS denial_rate,
       underpay_rate_pct AS underpay_rate, avg_days_to_resolve, pct_ar_90plus, total_billed, total_paid,
       (SELECT CAST(count(*) AS BIGINT) FROM scorecard) AS summary_n_payers,
       (SELECT payer FROM scorecard WHERE payer_rank = 1) AS summary_best_payer,
       DATE '2001-08-02' AS as_of_date
FROM scorecard""", O.SCORE))
def q_report_json_roundtrip(spark, sf_dir):
    from pyspark.sql import functions as F

    _, doc = _published_scorecard(spark, sf_dir)
    rows = doc.select(
        F.to_date("as_of_date").alias("as_of_date"),
        F.col("summary.n_payers").alias("summary_n_payers"),
        F.col("summary.best_payer").alias("summary_best_payer"),
        F.inline("scorecard"),
    )
    return rows


@product("scorecard_diff", "Q7 J10 F7 X9 T24", O.with_claims("""
SELECT payer, composite_score AS actual_score, composite_score AS published_score, grade AS actual_grade,
       grade AS published_grade, payer_rank AS actual_rank, payer_rank AS published_rank, true AS ok
FROM scorecard""", O.SCORE))
def q_scorecard_diff(spark, sf_dir):
    from pyspark.sql import functions as F

    s, doc = _published_scorecard(spark, sf_dir)
    published = doc.select(F.inline("scorecard"))
    return quality.scorecard_diff(scorecard.payer_scorecard(s, A), published)


_RECOVERY_SUMMARY_SQL = """
summary AS (
  SELECT CAST(coalesce(round(sum(recovery_potential), 0), 0) AS DOUBLE) AS total_recovery_potential,
         CAST(coalesce(round(sum(recovery_potential) FILTER (WHERE recovery_confidence = 'High'), 0), 0) AS DOUBLE)
           AS high_confidence_recovery,
         CAST(coalesce(round(sum(recovery_potential) FILTER (WHERE category = 'Underpayment'), 0), 0) AS DOUBLE)
           AS underpayment_recovery,
         CAST(coalesce(round(sum(recovery_potential) FILTER (WHERE category = 'Denial appeal'), 0), 0) AS DOUBLE)
           AS appeal_recovery,
         CAST(count(*) AS DOUBLE) AS n_opportunities
  FROM opp
)"""


@product("recovery_diff", "Q8 U2 J11 F7", O.with_claims("\nUNION ALL\n".join(
    f"SELECT '{m}' AS measure, {m} AS actual, {m} AS published, true AS ok FROM summary"
    for m in ["total_recovery_potential", "underpayment_recovery", "appeal_recovery",
              "high_confidence_recovery", "n_opportunities"]), O.OPP + "," + _RECOVERY_SUMMARY_SQL))
def q_recovery_diff(spark, sf_dir):
    from pyspark.sql import functions as F

    from claimlens.sinks.publish import new_scratch, publish_json, recovery_document
    from claimlens.sources.files import RECOVERY_DOC_SCHEMA, read_report

    s, sd = stg(spark, sf_dir), seed(spark)
    blocks = recovery.recovery_blocks(s, sd)  # summary + three breakdowns from one scan
    summary = blocks["summary"]
    doc = recovery_document(
        summary,
        recovery.top_opportunities(s, sd, PARAMS.top_k),
        blocks["by_payer"],
        blocks["by_specialty"],
        blocks["by_reason"],
    )
    path = publish_json(doc, new_scratch(spark, "recovery_doc"))
    published = read_report(spark, path, RECOVERY_DOC_SCHEMA).select("summary.*")
    return quality.recovery_diff(summary, published)


# ---------------------------------------------------------------------------
# mart schema tests (the 15 unique / not_null / accepted_values tests)

_MART_CTES = O.SCORE + "," + O.OPEN_AR + "," + O.OPP + f""",
trend AS (
  SELECT claim_month, {O.rd("100.0 * count(*) FILTER (WHERE is_denied) / count(*)")} AS denial_rate_pct
  FROM stg GROUP BY claim_month
),
aging AS (SELECT payer, aging_bucket FROM oarb GROUP BY payer, aging_bucket)"""


def _mart_test_sql() -> str:
    def uniq(model, src, col):
        return (f"SELECT '{model}' AS model, 'unique' AS \"check\", '{col}' AS column_name, "
                f"CAST(count(*) AS BIGINT) AS failures FROM (SELECT {col} FROM {src} WHERE {col} IS NOT NULL "
                f"GROUP BY {col} HAVING count(*) > 1)")

    def nn(model, src, col):
        return (f"SELECT '{model}', 'not_null', '{col}', CAST(count(*) FILTER (WHERE {col} IS NULL) AS BIGINT) "
                f"FROM {src}")

    def acc(model, src, col, vals):
        lst = ", ".join(f"'{v}'" for v in vals)
        return (f"SELECT '{model}', 'accepted_values', '{col}', "
                f"CAST(count(*) FILTER (WHERE {col} IS NOT NULL AND {col} NOT IN ({lst})) AS BIGINT) FROM {src}")

    parts = [
        uniq("monthly_denial_trend", "trend", "claim_month"),
        nn("monthly_denial_trend", "trend", "claim_month"),
        nn("monthly_denial_trend", "trend", "denial_rate_pct"),
        nn("ar_aging_decision", "aging", "aging_bucket"),
        acc("ar_aging_decision", "aging", "aging_bucket", ["0-30", "31-60", "61-90", "90+"]),
        uniq("payer_scorecard", "scorecard", "payer"),
        nn("payer_scorecard", "scorecard", "payer"),
        nn("payer_scorecard", "scorecard", "composite_score"),
        acc("payer_scorecard", "scorecard", "grade", ["A", "B", "C", "D"]),
        uniq("recovery_opportunities", "opp", "claim_id"),
        nn("recovery_opportunities", "opp", "claim_id"),
        nn("recovery_opportunities", "opp", "recovery_potential"),
        acc("recovery_opportunities", "opp", "category", ["Underpayment", "Denial appeal"]),
        uniq("appeal_success_rates", "seed", "denial_code"),
        nn("appeal_success_rates", "seed", "denial_code"),
    ]
    return O.with_claims("\nUNION ALL\n".join(parts), _MART_CTES)


@product("dq_marts", "Q1 Q2 Q3", _mart_test_sql())
def q_dq_marts(spark, sf_dir):
    from claimlens.plans.build import mart_tests

    s, sd = stg(spark, sf_dir), seed(spark)
    return mart_tests(
        denials.monthly_denial_trend(s),
        aging.ar_aging(s, A),
        scorecard.payer_scorecard(s, A),
        recovery.opportunities(s, sd),
        sd,
    )


@product("recovery_ratios", "N5", O.with_claims(f"""
SELECT {O.r("100.0 * (SELECT sum(recovery_potential) FROM opp) / nullif((SELECT sum(billed_amount) FROM stg), 0)", 2)}
         AS recovery_pct_of_billed,
       {O.r("100.0 * (SELECT sum(recovery_potential) FROM opp WHERE recovery_confidence = 'High') / nullif((SELECT sum(recovery_potential) FROM opp), 0)", 2)}
         AS high_confidence_share_pct""", O.OPP))
def q_recovery_ratios(spark, sf_dir):
    return recovery.recovery_ratios(stg(spark, sf_dir), seed(spark))


# ---------------------------------------------------------------------------
# SQL text over the registered views (the rewritten query forms, run by Spark SQL)

SQL_AS_OF = "DATE'2001-08-02'"
_RATE = "CAST(round(CAST({} AS DECIMAL(24,6)), 1) AS DOUBLE)"

# Each states its question over the registered views in Spark SQL's own terms.
SQL_TEXT = {
    # lateral aliases: a column of the same SELECT named before it is used
    "sql_denial_rate_by_payer": f"""
SELECT payer_name, count(*) AS total_claims, count_if(c.claim_status = 'Denied') AS denied_claims,
       {_RATE.format("denied_claims * 100.0 / total_claims")} AS denial_rate_pct
FROM claims c JOIN payers USING (payer_id)
WHERE c.claim_date >= {SQL_AS_OF} - INTERVAL 12 MONTHS AND c.claim_month >= trunc({SQL_AS_OF} - INTERVAL 12 MONTHS, 'MM')
GROUP BY payer_name ORDER BY denial_rate_pct DESC, payer_name""",
    "sql_ar_aging_by_payer": f"""
SELECT payer_name, band.label AS aging_bucket, count(*) AS claim_count, CAST(round(sum(billed_amount), 2) AS DOUBLE) AS billed_in_bucket
FROM (SELECT payer_id, billed_amount,
             CASE WHEN days BETWEEN 31 AND 60 THEN struct(2 AS place, '31-60' AS label) WHEN days BETWEEN 61 AND 90 THEN struct(3 AS place, '61-90' AS label)
                  WHEN days > 90 THEN struct(4 AS place, '90+' AS label) ELSE struct(1 AS place, '0-30' AS label) END AS band
      FROM (SELECT *, datediff({SQL_AS_OF}, claim_date) AS days FROM claims) WHERE claim_status IN ('Denied', 'Pending'))
JOIN payers USING (payer_id)
GROUP BY payer_name, band ORDER BY payer_name, band.place""",
    "sql_underpayment_join": """
SELECT claim_id, payer_id, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(paid_amount AS DOUBLE) AS paid_amount,
       CAST(expected_rate AS DOUBLE) AS expected_rate, CAST(round(due - c.paid_amount, 2) AS DOUBLE) AS underpayment_gap
FROM (SELECT c.*, r.expected_rate, c.billed_amount * r.expected_rate AS due
      FROM claims c JOIN expected_rates r USING (payer_id, specialty) WHERE claim_status = 'Paid') AS c
WHERE c.paid_amount < due * 0.95
ORDER BY underpayment_gap DESC, claim_id""",
    "sql_monthly_trend": f"""
SELECT claim_month, n AS total_claims, d AS denied_claims, {_RATE.format("pct")} AS denial_rate_pct,
       {_RATE.format("pct - lag(pct) OVER (ORDER BY claim_month)")} AS pct_change_vs_prior_month
FROM (SELECT claim_month, count(*) AS n, count_if(claim_status = 'Denied') AS d, d * 100.0 / n AS pct FROM claims GROUP BY claim_month)
ORDER BY claim_month""",
    # the caller's organizations as a SQL table function
    "sql_tenant_read": f"""
SELECT org_id, external_ref, service_date, procedure_code, insurer_name, CAST(charge_amount AS DOUBLE) AS charge_amount,
       CAST(remit_amount AS DOUBLE) AS remit_amount, record_status, adjustment_code, decision_date
FROM claim_records WHERE org_id IN (SELECT org_id FROM user_org_ids({TENANT_USER})) ORDER BY service_date, external_ref""",
}


def _sql_product(name: str, ids: str, oracle_of: str):
    def run(spark, sf_dir):
        from claimlens.plans.sql import register_views

        register_views(spark, sf_dir)
        return spark.sql(SQL_TEXT[name])

    run.__name__ = f"q_{name}"
    product(name, ids, REGISTRY[oracle_of].oracle)(run)


_sql_product("sql_denial_rate_by_payer", "G2 F1 J2 P6 P11 O1 (SQL text, plain form)", "denial_rate_by_payer_12m")
_sql_product("sql_tenant_read", "RL1 RL2 D1 (SQL text)", "tenant_read")
_sql_product("sql_ar_aging_by_payer", "G4 X3 B1 P11 (SQL text)", "ar_aging_submission")
_sql_product("sql_underpayment_join", "G5 J3 J4 (SQL text)", "underpayment_detection")
_sql_product("sql_monthly_trend", "G6 W1 (SQL text)", "monthly_trend_raw")



@product("trend_report_roundtrip", "G11 G12 G13 G14 G15 X19 (document)", O.with_claims(f"""
SELECT strftime(claim_month, '%Y-%m') AS claim_month, CAST(total_claims AS BIGINT) AS total_claims,
       CAST(denied AS BIGINT) AS denied, underpaid_amt, billed, denial_rate_pct,
       (SELECT CAST(count(*) AS BIGINT) FROM stg) AS kpi_total_claims,
       (SELECT count(DISTINCT payer) FROM stg) AS n_payer_rows,
       (SELECT count(DISTINCT denial_code) FROM stg WHERE is_denied) AS n_reason_rows
FROM (
  SELECT claim_month, count(*) AS total_claims, count(*) FILTER (WHERE is_denied) AS denied,
         CAST(coalesce(round(sum(underpayment_gap) FILTER (WHERE is_underpaid), 2), 0) AS DOUBLE) AS underpaid_amt,
         CAST(round(sum(billed_amount), 2) AS DOUBLE) AS billed,
         {O.r("100.0 * count(*) FILTER (WHERE is_denied) / count(*)")} AS denial_rate_pct
  FROM stg GROUP BY claim_month)"""))
def q_trend_report_roundtrip(spark, sf_dir):
    """Publish the denial-trend report object and read it back: the monthly
    block as rows, with the KPI claim count and the block sizes."""
    from pyspark.sql import functions as F

    from claimlens.sinks.publish import new_scratch, publish_json, trend_document
    from claimlens.sources.files import TREND_DOC_SCHEMA, read_report

    s, sd = stg(spark, sf_dir), seed(spark)
    blocks = denials.report_blocks(recovery.with_recovery(s, sd), sd)  # one scan for all five blocks
    doc = trend_document(blocks["kpi"], blocks["monthly"], blocks["by_payer"], blocks["by_reason"],
                         blocks["by_specialty"])
    path = publish_json(doc, new_scratch(spark, "trend_report"))
    back = read_report(spark, path, TREND_DOC_SCHEMA)
    return back.select(
        F.col("kpi.total_claims").alias("kpi_total_claims"),
        F.size("by_payer").cast("bigint").alias("n_payer_rows"),
        F.size("by_reason").cast("bigint").alias("n_reason_rows"),
        F.inline("monthly"),
    )


from claimlens import catalog_checks, catalog_stores  # noqa: E402, F401  (register their products)
