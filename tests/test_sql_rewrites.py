"""SQL text over the views, and the operators behind it, on small frames worked out by hand."""

import datetime as dt
from decimal import Decimal

import pytest

from claimlens import catalog
from claimlens.operators import aging, denials, recovery
from claimlens.plans.sql import register_views

from conftest import SF_SMALL

D = dt.date


@pytest.fixture(scope="module")
def views(spark):
    register_views(spark, SF_SMALL)
    return spark


def warehouse(spark, rows):
    """(claim_id, payer_id, specialty, claim_date, status, billed, paid)"""
    full = [(c, p, s, d, st, Decimal(b), Decimal(a)) for c, p, s, d, st, b, a in rows]
    return spark.createDataFrame(full, "claim_id string, payer_id int, specialty string, claim_date date, status string, "
                                       "billed_amount decimal(12,2), paid_amount decimal(12,2)")


def test_denial_rate_by_hand(spark):
    claims = warehouse(spark, [
        ("a", 1, "S", D(2001, 8, 1), "Denied", 10, 0), ("b", 1, "S", D(2001, 1, 1), "Paid", 10, 9), ("c", 1, "S", D(2000, 8, 2), "Pending", 10, 0),
        ("d", 1, "S", D(2000, 8, 1), "Denied", 10, 0),  # a day before the window
        ("e", 2, "S", D(2001, 7, 1), "Denied", 10, 0), ("f", 3, "S", D(2001, 7, 1), "Denied", 10, 0),
    ])
    payers = spark.createDataFrame([(1, "One"), (2, "Two")], "payer_id int, payer_name string")  # payer 3 is unknown
    for pre in (True, False):
        got = denials.denial_rate_by_payer(claims, payers, D(2001, 8, 2), 12, pre_aggregate=pre).collect()
        assert [tuple(r) for r in got] == [("Two", 1, 1, 100.0), ("One", 3, 1, 33.3)]


def test_aging_by_hand(spark):
    as_of = D(2001, 8, 2)
    ages = [0, 30, 31, 60, 61, 90, 91, 400]
    claims = warehouse(spark, [(f"c{a}", 1, "S", as_of - dt.timedelta(days=a), "Denied" if a % 2 else "Pending", 10, 0) for a in ages]
                       + [("paid", 1, "S", as_of, "Paid", 10, 10)])
    got = {r["days_outstanding"]: r["aging_bucket"] for r in aging.ar_aging_claims(claims, as_of).collect()}
    assert got == {0: "0-30", 30: "0-30", 31: "31-60", 60: "31-60", 61: "61-90", 90: "61-90", 91: "90+", 400: "90+"}


def test_underpayment_by_hand(spark):
    claims = warehouse(spark, [
        ("low", 1, "S", D(2001, 1, 1), "Paid", 100, 70),   # 80 due, 76 tolerated
        ("edge", 1, "S", D(2001, 1, 1), "Paid", 100, 76), ("fine", 1, "S", D(2001, 1, 1), "Paid", 100, 80),
        ("label", 1, "S", D(2001, 1, 1), "Paid - Underpaid", 100, 10), ("open", 1, "S", D(2001, 1, 1), "Pending", 100, 0),
        ("lower", 1, "S", D(2001, 1, 1), "Paid", 200, 100), ("norate", 1, "T", D(2001, 1, 1), "Paid", 100, 0),
    ])
    rates = spark.createDataFrame([(1, "S", Decimal("0.80"))], "payer_id int, specialty string, expected_rate decimal(4,2)")
    got = [(r["claim_id"], r["underpayment_gap"]) for r in recovery.underpayment_detection(claims, rates).collect()]
    assert got == [("lower", 60.0), ("low", 10.0)]


def test_trend_by_hand(spark):
    from conftest import make_stg

    rows = [(f"{m}-{i}", D(2001, m, 3), "P", "S", 10, 0, "Denied" if i < denied else "Paid", "CO-16" if i < denied else None, 5, None)
            for m, n, denied in [(1, 3, 1), (2, 3, 2), (4, 7, 1)] for i in range(n)]
    got = denials.monthly_trend_raw(make_stg(spark, rows)).collect()
    # 33.33.., 66.66.., 14.28..: changes of the unrounded rates; the month without claims has no row
    assert [(r["claim_month"].month, r["denial_rate_pct"], r["pct_change_vs_prior_month"]) for r in got] == [(1, 33.3, None), (2, 66.7, 33.3), (4, 14.3, -52.4)]


def test_sql_text_is_in_order(views):
    got = catalog.REGISTRY["sql_denial_rate_by_payer"].fn(views, SF_SMALL).collect()
    assert [r["denial_rate_pct"] for r in got] == sorted((r["denial_rate_pct"] for r in got), reverse=True)
    got = catalog.REGISTRY["sql_underpayment_join"].fn(views, SF_SMALL).collect()
    assert len(got) > 0 and [r["underpayment_gap"] for r in got] == sorted((r["underpayment_gap"] for r in got), reverse=True)
    got = [(r["payer_name"], r["aging_bucket"]) for r in catalog.REGISTRY["sql_ar_aging_by_payer"].fn(views, SF_SMALL).collect()]
    assert got == sorted(got, key=lambda r: (r[0], ["0-30", "31-60", "61-90", "90+"].index(r[1])))


def test_sql_table_function(views):
    got = [r[0] for r in views.sql("SELECT * FROM user_org_ids(1)").collect()]
    assert got == [1]
    visible = views.sql("SELECT count(*) FROM claim_records WHERE org_id IN (SELECT org_id FROM user_org_ids(1))").first()[0]
    assert visible == catalog.REGISTRY["sql_tenant_read"].fn(views, SF_SMALL).count() > 0
