"""Tenant operators (RL1-RL5), data-quality checks (Q1-Q6), sources and sinks
(S1-S6, K1-K7) and the end-to-end build, on hand-made frames."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from claimlens.operators import quality, tenant
from claimlens.plans.build import build_all
from claimlens.sinks import publish
from claimlens.sinks.commits import Store
from claimlens.sources import files
from claimlens.sources.synthetic import synthetic_claims

from conftest import SF_SMALL

USERS = "user_id long, org_id int, email string, user_role string"
RECORDS = "org_id int, external_ref string, charge_amount decimal(12,2), submitted_by long"


def _users(spark):
    return spark.createDataFrame(
        [(1, 10, "a@x", "admin"), (2, 10, "b@x", "analyst"), (3, 20, "c@x", "viewer"), (4, None, "d@x", "viewer")],
        USERS)


def _records(spark):
    from decimal import Decimal

    return spark.createDataFrame(
        [(10, "R1", Decimal("5"), 1), (10, "R2", Decimal("6"), 3), (20, "R3", Decimal("7"), 3),
         (20, "R4", Decimal("8"), 2), (None, "R5", Decimal("9"), 1)], RECORDS)


def test_orgs_and_scoped_read(spark):
    u, r = _users(spark), _records(spark)
    assert [x[0] for x in tenant.orgs_of(u, 1).collect()] == [10]
    assert sorted(x["external_ref"] for x in tenant.scoped_read(r, u, 1).collect()) == ["R1", "R2"]
    assert tenant.scoped_read(r, u, 4).count() == 0  # user without org sees nothing
    assert tenant.scoped_read(r, u, 99).count() == 0  # unknown user sees nothing


def test_own_profile(spark):
    assert [x["email"] for x in tenant.own_profile(_users(spark), 2).collect()] == ["b@x"]


def test_append_accept_reject(spark):
    u, r = _users(spark), _records(spark)
    acc = sorted(x["external_ref"] for x in tenant.append_accepted(r, u).collect())
    rej = sorted(x["external_ref"] for x in tenant.append_rejected(r, u).collect())
    # R1 admin in own org; R2 viewer -> rejected; R3 viewer -> rejected;
    # R4 analyst of org 10 writing into org 20 -> rejected; R5 NULL org -> rejected
    assert acc == ["R1"] and rej == ["R2", "R3", "R4", "R5"]


def test_deny_by_default(spark):
    assert tenant.allowed("claim_records", "insert")
    assert not tenant.allowed("claim_records", "update")
    assert not tenant.allowed("report_runs", "insert")
    assert not tenant.allowed("organizations", "delete")
    req = spark.createDataFrame([("claim_records", "delete"), ("report_runs", "select")], "table_name string, action string")
    assert [x["allowed"] for x in tenant.split_requests(req).collect()] == [False, True]


def test_unique_not_null_accepted_range_fk(spark):
    from decimal import Decimal

    r = spark.createDataFrame(
        [(10, "D1", Decimal("1"), "paid"), (10, "D1", Decimal("-2"), "bogus"), (20, "D1", None, "paid"),
         (None, "D2", Decimal("3"), None)],
        "org_id int, external_ref string, charge_amount decimal(12,2), record_status string")
    dup = quality.unique_failures(r, ["org_id", "external_ref"]).collect()
    assert [(x["org_id"], x["external_ref"], x["occurrences"]) for x in dup] == [(10, "D1", 2)]
    s = {(x["check"], x["column_name"]): x["failures"] for x in quality.summary(
        "claim_records", r, not_null=["org_id", "charge_amount"], accepted={"record_status": ["paid", "denied", "pending"]},
        non_negative=["charge_amount"]).collect()}
    assert s == {("not_null", "org_id"): 1, ("not_null", "charge_amount"): 1,
                 ("accepted_values", "record_status"): 1, ("non_negative", "charge_amount"): 1}
    orgs = spark.createDataFrame([(10,)], "org_id int")
    fk = quality.foreign_key_failures(r, orgs, "org_id").collect()
    assert [x["org_id"] for x in fk] == [20]  # NULL org is not an FK failure


def test_defaults_on_write(spark):
    df = spark.createDataFrame([("u1", None)], "user_id string, user_role string")
    out = quality.with_defaults(df, {"user_role": "viewer", "created_at": F.current_timestamp()}).first()
    assert out["user_role"] == "viewer" and out["created_at"] is not None


def test_scorecard_diff_full_outer_and_null_safe(spark):
    actual = spark.createDataFrame(
        [(1, "A", "B", 70.0, 10.0, 5.0, 17.0, 10.0, 100.0, 1.0), (2, "B", "D", None, 11.0, 5.0, 17.0, 10.0, 100.0, 1.0)],
        "payer_rank long, payer string, grade string, composite_score double, denial_rate_pct double, "
        "underpay_rate_pct double, avg_days_to_resolve double, pct_ar_90plus double, total_billed double, total_paid double")
    published = spark.createDataFrame(
        [(1, "A", "B", 70.04, 10.0, 5.0, 17.0, 10.0, 100.5, 1.0), (2, "B", "D", 35.0, 11.0, 5.0, 17.0, 10.0, 100.0, 1.0),
         (3, "C", "D", 30.0, 11.0, 5.0, 17.0, 10.0, 100.0, 1.0)],
        "rank long, payer string, grade string, composite_score double, denial_rate double, underpay_rate double, "
        "avg_days_to_resolve double, pct_ar_90plus double, total_billed double, total_paid double")
    got = {x["payer"]: x["ok"] for x in quality.scorecard_diff(actual, published).collect()}
    assert got == {"A": True, "B": False, "C": False}


def test_synthetic_claims_deterministic_and_distributed(spark):
    a = synthetic_claims(spark, 20000, num_partitions=3)
    b = synthetic_claims(spark, 20000, num_partitions=11)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    stats = a.groupBy("record_status").count().collect()
    share = {x["record_status"]: x["count"] / 20000 for x in stats}
    assert abs(share["paid"] - 0.74) < 0.02 and abs(share["denied"] - 0.18) < 0.02
    r = a.agg(F.min("charge_amount"), F.max("charge_amount"), F.min("service_date"), F.max("service_date")).first()
    assert float(r[0]) >= 120 and float(r[1]) < 600
    assert r[2] >= dt.date(2026, 1, 1) and r[3] < dt.date(2026, 6, 30)
    assert a.filter("record_status != 'paid' and remit_amount != 0").count() == 0
    assert a.first()["external_ref"].startswith("DEMO-")


def test_seed_csv_and_report_json_sources(spark, tmp_path):
    seed = tmp_path / "seed.csv"
    seed.write_text("denial_code,denial_reason_label,appeal_success_rate\nCO-16,Missing claim information,0.55\n")
    df = files.read_seed_csv(spark, str(seed))
    assert df.schema["appeal_success_rate"].dataType.typeName() == "double"
    doc = {"summary": {"total_recovery_potential": 1.0, "high_confidence_recovery": 1.0, "underpayment_recovery": 0.0,
                       "appeal_recovery": 1.0, "n_opportunities": 1, "total_billed_universe": 9.0},
           "top25": [], "by_payer": [{"payer": "A", "recovery_potential": 1.0}], "by_specialty": [], "by_reason": []}
    p = tmp_path / "doc.json"
    p.write_text(json.dumps(doc, indent=2))
    r = files.read_report(spark, str(p), files.RECOVERY_DOC_SCHEMA)
    assert r.select("summary.n_opportunities").first()[0] == 1
    assert r.select(F.inline("by_payer")).first()["payer"] == "A"


def test_run_record_append(spark, tmp_path):
    orgs = spark.createDataFrame([(10,), (20,)], "org_id int")
    payload = spark.createDataFrame([(5, 1.5)], "n long, v double")
    store = Store(spark, str(tmp_path / "runs"))
    first = dt.datetime(2026, 1, 2, 3, 4, 5)
    for _ in range(2):  # the same run, appended again
        runs = publish.append_run(spark, store, orgs, payload, first)
    assert runs.count() == 2 and runs.select("run_id").distinct().count() == 2
    assert json.loads(runs.first()["summary_payload"]) == {"n": 5, "v": 1.5}
    ids = {r["run_id"] for r in runs.collect()}
    assert all(uuid.UUID(x).version == 3 and uuid.UUID(x).variant == uuid.RFC_4122 for x in ids)
    publish.append_run(spark, store, orgs, payload, first + dt.timedelta(hours=1))
    assert publish.read_runs(store).count() == 4
    # a task that was run twice under another batch name leaves the same ids
    store.append(store.read().limit(1), "again")
    assert store.read().count() == 5 and publish.read_runs(store).count() == 4
    with pytest.raises(ValueError):
        publish.append_run(spark, store, orgs, payload.unionByName(payload), first)


def test_build_all_end_to_end(spark, tmp_path):
    res = build_all(spark, SF_SMALL, str(tmp_path / "out"))
    failures = res.test_failures.filter("failures > 0").collect()
    assert failures == []
    assert res.scorecard_check.filter("not ok").count() == 0
    assert res.recovery_check.filter("not ok").count() == 0
    stg = spark.read.parquet(res.paths["stg_claims"])
    assert stg.count() == 1500
    assert "claim_month" in stg.columns


def test_validate_append_reasons(spark):
    from decimal import Decimal

    users = spark.createDataFrame([(1, 10, "a@x", "admin"), (3, 10, "c@x", "viewer")],
                                  "user_id long, org_id int, email string, user_role string")
    cols = ("org_id int, external_ref string, service_date date, procedure_code string, insurer_name string, "
            "charge_amount decimal(12,2), remit_amount decimal(12,2), record_status string, submitted_by long")
    d = dt.date(2026, 1, 2)
    batch = spark.createDataFrame([
        (10, "OK", d, "90001", "A", Decimal("5"), Decimal("0"), "paid", 1),
        (10, "VIEW", d, "90001", "A", Decimal("5"), Decimal("0"), "paid", 3),      # viewer
        (10, "NULL", None, "90001", "A", Decimal("5"), Decimal("0"), "paid", 1),   # missing date
        (10, "NEG", d, "90001", "A", Decimal("-1"), Decimal("0"), "paid", 1),      # negative charge
        (10, "BAD", d, "90001", "A", Decimal("5"), Decimal("0"), "bogus", 1),      # bad status
        (10, "DUP", d, "90001", "A", Decimal("5"), Decimal("0"), "paid", 1),
        (10, "DUP", d, "90001", "A", Decimal("6"), Decimal("0"), "paid", 1),       # duplicate key in batch
        (10, "OLD", d, "90001", "A", Decimal("5"), Decimal("0"), "paid", 1),       # already in the store
        (10, "MINE", d, "90001", "A", Decimal("5"), Decimal("0"), "paid", 1),      # an outsider sends the same key: no hindrance
        (10, "MINE", d, "90001", "A", Decimal("5"), Decimal("0"), "paid", 4),
        (10, "HALF", d, "90001", "A", Decimal("5"), Decimal("0"), "bogus", 1),     # nor a rejected row of one's own
        (10, "HALF", d, "90001", "A", Decimal("5"), None, "paid", 1),
    ], cols)
    existing = spark.createDataFrame([(10, "OLD"), (20, "OK")], "org_id int, external_ref string")
    got = sorted(((r["external_ref"], r["reject_reason"])
                 for r in tenant.validate_append(batch, users, existing).collect()), key=str)
    want = [("BAD", "bad_status"), ("DUP", "duplicate_in_batch"), ("DUP", "duplicate_in_batch"), ("HALF", None), ("HALF", "bad_status"),
            ("MINE", None), ("MINE", "not_writer"), ("NEG", "negative_amount"), ("NULL", "null_field"), ("OK", None), ("OLD", "already_exists"), ("VIEW", "not_writer")]
    assert got == sorted(want, key=str)


def test_build_runs_the_staged_and_mart_schema_tests(spark, tmp_path):
    res = build_all(spark, SF_SMALL, str(tmp_path / "out2"), threads=1)
    checks = {(r["model"], r["check"], r["column_name"]) for r in res.test_failures.collect()}
    assert ("stg_claims", "unique", "claim_id") in checks
    assert ("stg_claims", "accepted_values", "status") in checks
    assert len([c for c in checks if c[0] == "stg_claims"]) == 6
    assert len(checks) == 21  # 6 staging + 13 mart + 2 seed schema tests
