"""Hand-made edge frames (FIXTURES.md §4) not covered by the trap tests."""

import datetime as dt

from pyspark.sql import functions as F

from claimlens.functions.bands import confidence
from claimlens.operators import demo, quality, recovery, scorecard

from conftest import make_stg

AS_OF = dt.date(2025, 7, 1)


def test_all_payers_equal_on_one_metric_gives_null_composites(spark):
    # every payer: 1 denied of 2 claims (equal denial rate) -> that term is NULL for all
    rows = []
    for p, days in [("A", 5), ("B", 9), ("C", 14)]:
        rows += [(f"{p}1", "2025-01-02", p, "S", 10, 0, "Denied", "CO-16", days, None),
                 (f"{p}2", "2025-01-02", p, "S", 10, 8, "Paid", None, days + 1, None)]
    sc = scorecard.payer_scorecard(make_stg(spark, rows), AS_OF).collect()
    assert all(r["composite_score"] is None and r["grade"] == "D" for r in sc)
    assert sorted(r["payer_rank"] for r in sc) == [1, 2, 3]  # ties resolved, ranks stay unique


def test_confidence_tier_edges(spark):
    df = spark.createDataFrame([(0.50,), (0.49,), (0.28,), (0.25,), (0.24,), (0.0,)], "r double")
    assert [x[0] for x in df.select(confidence("r")).collect()] == ["High", "Medium", "Medium", "Medium", "Low", "Low"]


def test_duplicate_rate_row_duplicates_claims_and_is_caught(spark):
    claims = spark.createDataFrame([("x1", 1, "S", 100.0, 50.0, "Paid")],
                                   "claim_id string, payer_id int, specialty string, billed_amount double, "
                                   "paid_amount double, status string")
    rates = spark.createDataFrame([(1, "S", 0.60), (1, "S", 0.70)], "payer_id int, specialty string, expected_rate double")
    assert recovery.underpayment_detection(claims, rates).count() == 2  # join form duplicates
    dup = quality.unique_failures(rates, ["payer_id", "specialty"]).collect()
    assert [(r["payer_id"], r["specialty"], r["occurrences"]) for r in dup] == [(1, "S", 2)]


def test_null_insurer_is_dropped_from_insurer_rates(spark):
    rec = spark.createDataFrame(
        [(None, dt.date(2026, 1, 5), "denied"), ("A", dt.date(2026, 1, 6), "paid"), ("A", dt.date(2026, 1, 7), "denied")],
        "insurer_name string, service_date date, record_status string")
    got = demo.insurer_denial_rate(rec).collect()
    assert [(r["insurer_name"], r["denial_rate_pct"]) for r in got] == [("A", 50.0)]


def test_duplicate_external_ref_only_within_one_org_is_a_violation(spark):
    r = spark.createDataFrame([(1, "E1"), (1, "E1"), (2, "E2"), (3, "E2")], "org_id int, external_ref string")
    dup = quality.unique_failures(r, ["org_id", "external_ref"]).collect()
    assert [(x["org_id"], x["external_ref"]) for x in dup] == [(1, "E1")]


def test_published_document_missing_a_payer_is_reported(spark):
    actual = spark.createDataFrame(
        [(1, "A", "B", 70.0, 10.0, 5.0, 17.0, 10.0, 100.0, 1.0), (2, "B", "C", 55.0, 11.0, 5.0, 17.0, 10.0, 100.0, 1.0)],
        "payer_rank long, payer string, grade string, composite_score double, denial_rate_pct double, "
        "underpay_rate_pct double, avg_days_to_resolve double, pct_ar_90plus double, total_billed double, total_paid double")
    published = actual.select(F.col("payer_rank").alias("rank"), "payer", "grade", "composite_score",
                              F.col("denial_rate_pct").alias("denial_rate"), F.col("underpay_rate_pct").alias("underpay_rate"),
                              "avg_days_to_resolve", "pct_ar_90plus", "total_billed", "total_paid").filter("payer = 'A'")
    got = {r["payer"]: r["ok"] for r in quality.scorecard_diff(actual, published).collect()}
    assert got == {"A": True, "B": False}


def test_label_formatting(spark):
    from claimlens.functions import fmt

    df = spark.createDataFrame([(dt.date(2024, 7, 1), 1234567.5, 17.45, 7)],
                               "m date, money double, rate double, n int")
    r = df.select(fmt.month_label("m").alias("label"), fmt.month_key("m").alias("key"),
                  fmt.month_from_key(fmt.month_key("m")).alias("back"), fmt.money_text("money").alias("usd"),
                  fmt.money_k_text("money").alias("usd_k"), fmt.pct_text("rate").alias("pct"),
                  fmt.padded_id("DEMO-", "n").alias("id")).first()
    assert (r["label"], r["key"], r["back"]) == ("Jul 24", "2024-07", dt.date(2024, 7, 1))
    assert (r["usd"], r["usd_k"], r["pct"], r["id"]) == ("$1,234,568", "$1235K", "17.5%", "DEMO-0007")
