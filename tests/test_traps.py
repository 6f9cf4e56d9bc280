"""t3: the semantic traps, one hand-made frame each."""

import datetime as dt

from pyspark.sql import functions as F

from claimlens.functions.rounding import int_days, rpt
from claimlens.operators import aging, demo, denials, recovery, scorecard
from claimlens.operators.staging import stg_claims

from conftest import make_stg

AS_OF = dt.date(2025, 7, 1)


def test_two_aging_clocks(spark):
    # denied 200 days ago, decided after 10 days: decision clock 10, submission clock 200
    stg = make_stg(spark, [("a", "2024-12-13", "P", "S", 100, 0, "Denied", "CO-16", 10, None)])
    dec = aging.ar_aging(stg, AS_OF, "decision").first()
    sub = aging.ar_aging(stg, AS_OF, "submission").first()
    assert dec["aging_bucket"] == "0-30" and sub["aging_bucket"] == "90+"


def test_pending_ages_from_submission(spark):
    stg = make_stg(spark, [("a", "2025-05-17", "P", "S", 100, 0, "Pending", None, None, None)])
    assert aging.open_ar(stg, AS_OF).first()["days_outstanding"] == 45


def test_bucket_edges_and_null_days(spark):
    from claimlens.functions.bands import aging_bucket

    df = spark.createDataFrame([(d,) for d in [30, 31, 60, 61, 90, 91, None]], "d int")
    got = [r[0] for r in df.select(aging_bucket("d")).collect()]
    assert got == ["0-30", "31-60", "31-60", "61-90", "61-90", "90+", "90+"]


def test_integer_cast_rounds_half_even(spark):
    df = spark.createDataFrame([(89.5,), (90.4,), (90.5,), (90.6,)], "d double")
    assert [r[0] for r in df.select(int_days("d")).collect()] == [90, 90, 90, 91]


def test_decimal_rounding_is_half_up(spark):
    df = spark.createDataFrame([(1.005,), (0.285,)], "x double")
    assert [r[0] for r in df.select(rpt("x", 2)).collect()] == [1.01, 0.29]


def test_two_denominators(spark):
    # 1 paid, 1 denied, 2 pending: submitted basis 25 %, decided basis 50 %
    rows = [("a", "2025-01-02", "P", "S", 10, 8, "Paid", None, 3, None),
            ("b", "2025-01-03", "P", "S", 10, 0, "Denied", "CO-16", 3, None),
            ("c", "2025-01-04", "P", "S", 10, 0, "Pending", None, None, None),
            ("d", "2025-01-05", "P", "S", 10, 0, "Pending", None, None, None)]
    stg = make_stg(spark, rows)
    assert denials.monthly_denial_trend(stg).first()["denial_rate_pct"] == 25.0
    rec = stg.select(F.col("payer").alias("insurer_name"), F.col("claim_date").alias("service_date"),
                     F.col("billed_amount").alias("charge_amount"), F.col("paid_amount").alias("remit_amount"),
                     F.lower(F.when(F.col("status") == "Paid", "paid").otherwise(F.col("status"))).alias("record_status"))
    assert demo.insurer_denial_rate(rec).first()["denial_rate_pct"] == 50.0


def test_demo_kpi_empty_is_zero(spark):
    rec = spark.createDataFrame([], "insurer_name string, service_date date, charge_amount decimal(12,2), "
                                    "remit_amount decimal(12,2), record_status string")
    r = demo.demo_kpi(rec).first()
    assert r["claims"] == 0 and r["denial_pct"] == 0.0


def test_two_underpayment_definitions(spark):
    # labelled underpaid vs detected: paid exactly 0.95 x expected is not flagged (strict <)
    claims = spark.createDataFrame(
        [("x1", 1, "S", 100.0, 57.0, "Paid"), ("x2", 1, "S", 100.0, 56.99, "Paid"),
         ("x3", 1, "S", 100.0, 60.0, "Paid - Underpaid")],
        "claim_id string, payer_id int, specialty string, billed_amount double, paid_amount double, status string")
    rates = spark.createDataFrame([(1, "S", 0.60)], "payer_id int, specialty string, expected_rate double")
    got = [r["claim_id"] for r in recovery.underpayment_detection(claims, rates).collect()]
    assert got == ["x2"]


def test_round_before_normalise_and_null_composite(spark):
    # a single payer: max == min on every metric -> composite NULL -> grade D
    stg = make_stg(spark, [("a", "2025-01-02", "Solo", "S", 10, 0, "Denied", "CO-16", 3, None)])
    r = scorecard.payer_scorecard(stg, AS_OF).first()
    assert r["composite_score"] is None and r["grade"] == "D" and r["payer_rank"] == 1


def test_payer_without_open_ar_vanishes(spark):
    rows = [("a", "2025-01-02", "A", "S", 10, 0, "Denied", "CO-16", 3, None),
            ("b", "2025-01-02", "B", "S", 10, 8, "Paid", None, 3, None)]
    payers = {r["payer"] for r in scorecard.payer_scorecard(make_stg(spark, rows), AS_OF).collect()}
    assert payers == {"A"}


def test_scorecard_90plus_is_count_based(spark):
    rows = [("a", "2025-01-02", "A", "S", 1000, 0, "Denied", "CO-16", 120, None),
            ("b", "2025-01-02", "A", "S", 10, 0, "Denied", "CO-16", 5, None),
            ("c", "2025-01-02", "B", "S", 10, 0, "Denied", "CO-16", 5, None)]
    got = {r["payer"]: r["pct_ar_90plus"] for r in scorecard.payer_scorecard(make_stg(spark, rows), AS_OF).collect()}
    assert got["A"] == 50.0  # 1 of 2 claims, although 99 % of the dollars


def test_recovery_rules(spark):
    rows = [
        ("u", "2025-01-02", "P", "S", 100, 80, "Paid - Underpaid", None, 5, "12.345"),  # gap rounds in decimal
        ("p", "2025-01-02", "P", "S", 100, 0, "Denied", "PR-1", 5, None),  # rate 0: not an opportunity
        ("x", "2025-01-02", "P", "S", 100, 0, "Denied", "XX-9", 5, None),  # unknown code: dropped
        ("n", "2025-01-02", "P", "S", 100, 0, "Denied", "CO-50", 5, None),  # 0.28 -> Medium
        ("e", "2025-01-02", "P", "S", 100, 0, "Denied", "CO-45", 5, None),  # same label as underpayment
    ]
    opp = {r["claim_id"]: r for r in recovery.opportunities(make_stg(spark, rows), recovery.appeal_rates(spark)).collect()}
    assert set(opp) == {"u", "n", "e"}
    assert opp["n"]["recovery_confidence"] == "Medium"
    assert opp["u"]["reason"] == opp["e"]["reason"] == "Exceeds contracted rate"
    assert opp["u"]["category"] != opp["e"]["category"]


def test_recovery_rank_ties_break_on_claim_id(spark):
    rows = [(cid, "2025-01-02", "P", "S", 100, 0, "Denied", "CO-16", 5, None) for cid in ["b", "a", "c"]]
    opp = recovery.recovery_opportunities(make_stg(spark, rows), recovery.appeal_rates(spark))
    assert [r["claim_id"] for r in opp.orderBy("opportunity_rank").collect()] == ["a", "b", "c"]


def test_empty_claims_table(spark):
    stg = make_stg(spark, [])
    assert denials.monthly_denial_trend(stg).count() == 0
    assert recovery.recovery_opportunities(stg, recovery.appeal_rates(spark)).count() == 0
    s = recovery.recovery_summary(stg, recovery.appeal_rates(spark)).first()
    assert s["n_opportunities"] == 0 and s["total_recovery_potential"] == 0.0


def test_division_by_zero_is_null_not_error(spark):
    from claimlens.functions.rounding import rate_pct

    df = spark.createDataFrame([(1, 0)], "n long, d long")
    assert df.select(rate_pct("n", "d")).first()[0] is None


def test_staging_flags(spark):
    raw = spark.createDataFrame(
        [(s,) for s in ["Paid", "Paid - Underpaid", "Denied", "Pending"]], "status string"
    ).select("status", *[F.lit(None).cast("string").alias(c) for c in
                         ["claim_id", "claim_date", "payer", "specialty", "billed_amount", "paid_amount",
                          "denial_code", "denial_reason", "days_to_resolve", "underpayment_gap"]])
    got = {r["status"]: (r["is_denied"], r["is_underpaid"], r["is_open_ar"]) for r in stg_claims(raw).collect()}
    assert got == {"Paid": (False, False, False), "Paid - Underpaid": (False, True, False),
                   "Denied": (True, False, True), "Pending": (False, False, True)}
