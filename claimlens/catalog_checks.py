"""Products that prove the checks, the write path and the published documents.

Checks run over rule-made dirty tables and rule-altered documents, so that
every one of them has something to find; the same rules are stated in the
oracle SQL. ``k`` is the number in a claim's id.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import catalog as C
from claimlens import oracle as O
from claimlens import params as P
from claimlens.operators import denials, quality, recovery, scorecard, tenant
from claimlens.sources import fixture


def _k(ref: str) -> Column:
    return F.substring_index(ref, "-", -1).cast("bigint")


_SQL_K = "CAST(string_split({}, '-')[-1] AS BIGINT)"

# ---------------------------------------------------------------------------
# dirty tables

def dirty_claims(stg: DataFrame) -> DataFrame:
    """Staged claims with unknown statuses, missing payers, negative amounts,
    unknown codes, and every 109th claim twice."""
    k = _k("claim_id")
    d = stg.withColumns({
        "status": F.when(k % 101 == 0, "Lost").otherwise(F.col("status")),
        "payer": F.when(k % 103 != 0, F.col("payer")),
        "billed_amount": F.when(k % 107 == 0, -F.col("billed_amount")).otherwise(F.col("billed_amount")),
        "denial_code": F.when((k % 13 == 0) & F.col("denial_code").isNotNull(), "ZZ-9").otherwise(F.col("denial_code")),
    })
    return d.unionByName(d.filter(k % 109 == 0))


def dirty_users(users: DataFrame) -> DataFrame:
    """Users with an unknown role or organization, and shared addresses."""
    u = F.col("user_id")
    return users.withColumns({
        "user_role": F.when(u % 11 == 0, "owner").otherwise(F.col("user_role")),
        "org_id": F.when(u % 17 == 0, 99).otherwise(F.col("org_id")),
        "email": F.when(u % 19 == 0, "shared@example.org").when(u % 23 == 0, None).otherwise(F.col("email")),
    })


_DIRTY = f""",
dirty_claims AS (
  SELECT * FROM (
    SELECT claim_id, if(k % 101 = 0, 'Lost', status) AS status, if(k % 103 = 0, NULL, payer) AS payer,
           if(k % 107 = 0, -billed_amount, billed_amount) AS billed_amount, paid_amount,
           if(k % 13 = 0 AND denial_code IS NOT NULL, 'ZZ-9', denial_code) AS denial_code, unnest(range(if(k % 109 = 0, 2, 1))) AS copy
    FROM (SELECT *, {_SQL_K.format("claim_id")} AS k FROM stg))
),
dirty_users AS (
  SELECT user_id, if(user_id % 17 = 0, 99, org_id) AS org_id,
         CASE WHEN user_id % 19 = 0 THEN 'shared@example.org' WHEN user_id % 23 = 0 THEN NULL ELSE email END AS email,
         if(user_id % 11 = 0, 'owner', user_role) AS user_role
  FROM users
)"""


def _failures(table: str, check: str, column: str, where: str) -> str:
    return f"SELECT '{table}' AS table_name, '{check}' AS \"check\", '{column}' AS column_name, count(*) AS failures FROM dirty_{table} WHERE {where}"


@C.product("dq_dirty_columns", "Q2 Q3 Q4", O.with_claims("\nUNION ALL\n".join([
    _failures("claims", "not_null", "claim_id", "claim_id IS NULL"), _failures("claims", "not_null", "payer", "payer IS NULL"),
    _failures("claims", "accepted_values", "status", "status NOT IN ('Paid', 'Paid - Underpaid', 'Denied', 'Pending')"),
    _failures("claims", "non_negative", "billed_amount", "billed_amount < 0"), _failures("claims", "non_negative", "paid_amount", "paid_amount < 0"),
    _failures("users", "not_null", "email", "email IS NULL"),
    _failures("users", "accepted_values", "user_role", "user_role NOT IN ('admin', 'analyst', 'viewer')"),
]), O.TENANT + _DIRTY))
def q_dq_dirty_columns(spark, sf_dir):
    return quality.summary("claims", dirty_claims(C.stg(spark, sf_dir)), not_null=["claim_id", "payer"], accepted={"status": P.STATUSES},
                           non_negative=["billed_amount", "paid_amount"]).unionByName(
        quality.summary("users", dirty_users(C.users(spark, sf_dir)), not_null=["email"], accepted={"user_role": P.ROLES}))


@C.product("dq_dirty_unique", "Q1", O.with_claims("""
SELECT 'claims' AS table_name, claim_id AS key, count(*) AS occurrences FROM dirty_claims WHERE claim_id IS NOT NULL GROUP BY claim_id HAVING count(*) > 1
UNION ALL
SELECT 'users', email, count(*) FROM dirty_users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1""", O.TENANT + _DIRTY))
def q_dq_dirty_unique(spark, sf_dir):
    a = quality.unique_failures(dirty_claims(C.stg(spark, sf_dir)), ["claim_id"]).select(F.lit("claims").alias("table_name"), F.col("claim_id").alias("key"), "occurrences")
    b = quality.unique_failures(dirty_users(C.users(spark, sf_dir)), ["email"]).select(F.lit("users").alias("table_name"), F.col("email").alias("key"), "occurrences")
    return a.unionByName(b)


@C.product("dq_dirty_foreign_key", "Q5", O.with_claims("""
SELECT 'claims' AS table_name, denial_code AS key, count(*) AS failures FROM dirty_claims
WHERE denial_code IS NOT NULL AND denial_code NOT IN (SELECT denial_code FROM seed) GROUP BY denial_code
UNION ALL
SELECT 'users', CAST(org_id AS VARCHAR), count(*) FROM dirty_users WHERE org_id NOT IN (SELECT org_id FROM orgs) GROUP BY org_id""", O.TENANT + _DIRTY))
def q_dq_dirty_foreign_key(spark, sf_dir):
    a = quality.foreign_key_failures(dirty_claims(C.stg(spark, sf_dir)), C.seed(spark), "denial_code")
    b = quality.foreign_key_failures(dirty_users(C.users(spark, sf_dir)), fixture.organizations(spark, sf_dir), "org_id")
    outs = [(a, "claims", "denial_code"), (b, "users", "org_id")]
    return reduce(DataFrame.unionByName, [
        df.groupBy(F.col(c).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("failures")).select(F.lit(t).alias("table_name"), "key", "failures")
        for df, t, c in outs])


# ---------------------------------------------------------------------------
# altered documents

@C.product("scorecard_diff_altered", "Q7 T24 F7", O.with_claims("""
SELECT payer, composite_score AS actual_score,
       CASE WHEN payer_rank = 2 THEN NULL WHEN payer_rank % 3 = 0 THEN round(composite_score + 0.1, 1) ELSE composite_score END AS published_score,
       grade AS actual_grade, if(payer_rank = 2, NULL, if(payer_rank = 7, 'F', grade)) AS published_grade,
       payer_rank AS actual_rank, if(payer_rank = 2, NULL, payer_rank) AS published_rank,
       NOT (payer_rank = 2 OR payer_rank % 3 = 0 OR payer_rank = 7 OR payer_rank % 5 = 0) AS ok
FROM scorecard
UNION ALL SELECT 'NOBODY', NULL, 50.0, NULL, 'C', NULL, 99, false""", O.SCORE))
def q_scorecard_diff_altered(spark, sf_dir):
    """The published scorecard with wrong scores, grades and paid dollars, a payer missing and one too many."""
    s, doc = C._published_scorecard(spark, sf_dir)
    published = doc.select(F.inline("scorecard")).filter("rank <> 2")
    published = published.withColumns({
        "composite_score": F.when(F.col("rank") % 3 == 0, F.round(F.col("composite_score") + 0.1, 1)).otherwise(F.col("composite_score")),
        "grade": F.when(F.col("rank") == 7, "F").otherwise(F.col("grade")),
        "total_paid": F.when(F.col("rank") % 5 == 0, F.col("total_paid") + 5).otherwise(F.col("total_paid")),
    })
    extra = published.filter("rank = 1").withColumns({"payer": F.lit("NOBODY"), "rank": F.lit(99).cast(published.schema["rank"].dataType), "grade": F.lit("C"),
                                                      "composite_score": F.lit(50.0)})
    return quality.scorecard_diff(scorecard.payer_scorecard(s, C.A), published.unionByName(extra))


@C.product("recovery_diff_altered", "Q8 U2 F7", O.with_claims("""
SELECT measure, actual, actual + off AS published, off BETWEEN -1 AND 1 AND NOT (measure = 'n_opportunities' AND off <> 0) AS ok
FROM (SELECT unnest(['total_recovery_potential', 'underpayment_recovery', 'appeal_recovery', 'high_confidence_recovery', 'n_opportunities']) AS measure,
             unnest([total_recovery_potential, underpayment_recovery, appeal_recovery, high_confidence_recovery, n_opportunities]) AS actual,
             unnest([0.0, 1.0, 2.0, -1.0, 1.0]) AS off FROM summary)""", O.OPP + "," + C._RECOVERY_SUMMARY_SQL))
def q_recovery_diff_altered(spark, sf_dir):
    """A published summary that is off by nothing, by the tolerance, by more, and by one opportunity."""
    summary = recovery.recovery_summary(C.stg(spark, sf_dir), C.seed(spark))
    off = {"underpayment_recovery": 1, "appeal_recovery": 2, "high_confidence_recovery": -1, "n_opportunities": 1}
    return quality.recovery_diff(summary, summary.withColumns({c: F.col(c) + v for c, v in off.items()}))


# ---------------------------------------------------------------------------
# documents read back, with the place of each entry

def _published_recovery(spark, sf_dir) -> DataFrame:
    from claimlens.sinks.publish import new_scratch, publish_json, recovery_document
    from claimlens.sources.files import RECOVERY_DOC_SCHEMA, read_report

    s, sd = C.stg(spark, sf_dir), C.seed(spark)

    def publish():
        b = recovery.recovery_blocks(s, sd)
        doc = recovery_document(b["summary"], recovery.top_opportunities(s, sd, C.PARAMS.top_k), b["by_payer"], b["by_specialty"], b["by_reason"])
        return read_report(spark, publish_json(doc, new_scratch(spark, "recovery_doc")), RECOVERY_DOC_SCHEMA)

    return C.ref(spark, sf_dir, "recovery_document", publish)


def _placed(keys: str, order: str, body: str, block: str) -> str:
    return (f"SELECT '{block}' AS block, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS place, {keys} AS entry, value, n FROM ({body})")


_RECOVERY_BLOCKS_SQL = "\nUNION ALL\n".join([
    _placed("payer", "value DESC, payer", "SELECT payer, CAST(round(sum(recovery_potential), 2) AS DOUBLE) AS value, NULL::BIGINT AS n FROM opp GROUP BY payer", "by_payer"),
    _placed("specialty", "value DESC, specialty", "SELECT specialty, CAST(round(sum(recovery_potential), 2) AS DOUBLE) AS value, NULL::BIGINT AS n FROM opp GROUP BY specialty", "by_specialty"),
    _placed("category || ': ' || reason", "value DESC, category, reason",
            "SELECT category, reason, CAST(round(sum(recovery_potential), 2) AS DOUBLE) AS value, count(*) AS n FROM opp GROUP BY category, reason", "by_reason"),
    "SELECT * FROM (" + _placed("claim_id", "value DESC NULLS LAST, claim_id", "SELECT claim_id, CAST(recovery_potential AS DOUBLE) AS value, NULL::BIGINT AS n FROM opp", "top25") + ") WHERE place <= 25",
])


@C.product("recovery_document_blocks", "K4 S3 O8 G19 G20", O.with_claims(_RECOVERY_BLOCKS_SQL, O.OPP))
def q_recovery_document_blocks(spark, sf_dir):
    doc = _published_recovery(spark, sf_dir)

    def block(name: str, entry: str, value: str, n: str = "CAST(NULL AS BIGINT)") -> DataFrame:
        return doc.select(F.posexplode(name)).selectExpr(f"'{name}' AS block", "CAST(pos + 1 AS BIGINT) AS place", f"{entry} AS entry", f"{value} AS value", f"{n} AS n")

    return (block("by_payer", "col.payer", "col.recovery_potential").unionByName(block("by_specialty", "col.specialty", "col.recovery_potential"))
            .unionByName(block("by_reason", "col.category || ': ' || col.reason", "col.total_recovery", "CAST(col.claim_count AS BIGINT)"))
            .unionByName(block("top25", "col.claim_id", "col.recovery_potential")))


@C.product("scorecard_document_matrix", "K3 S3 G17 O3", O.with_claims("""
SELECT CAST(row_number() OVER (ORDER BY payer) AS BIGINT) AS place, payer,
       CAST(round(coalesce(sum(billed_amount) FILTER (aging_bucket = '0-30'), 0), 2) AS DOUBLE) AS b0,
       CAST(round(coalesce(sum(billed_amount) FILTER (aging_bucket = '31-60'), 0), 2) AS DOUBLE) AS b31,
       CAST(round(coalesce(sum(billed_amount) FILTER (aging_bucket = '61-90'), 0), 2) AS DOUBLE) AS b61,
       CAST(round(coalesce(sum(billed_amount) FILTER (aging_bucket = '90+'), 0), 2) AS DOUBLE) AS b90
FROM oarb GROUP BY payer""", O.OPEN_AR))
def q_scorecard_document_matrix(spark, sf_dir):
    _, doc = C._published_scorecard(spark, sf_dir)
    return doc.select(F.posexplode("aging_matrix")).selectExpr(
        "CAST(pos + 1 AS BIGINT) AS place", "col.payer AS payer", "col.`0-30` AS b0", "col.`31-60` AS b31", "col.`61-90` AS b61", "col.`90+` AS b90")


_TREND_SQL = "\nUNION ALL\n".join([
    f"""SELECT 'by_payer' AS block, CAST(row_number() OVER (ORDER BY rate DESC, payer) AS BIGINT) AS place, payer AS entry, rate, n
FROM (SELECT payer, {O.r("100.0 * count(*) FILTER (is_denied) / count(*)")} AS rate, count(*) AS n FROM stg GROUP BY payer)""",
    f"""SELECT 'by_specialty', CAST(row_number() OVER (ORDER BY rate DESC, specialty) AS BIGINT), specialty, rate, n
FROM (SELECT specialty, {O.r("100.0 * count(*) FILTER (is_denied) / count(*)")} AS rate, count(*) AS n FROM stg GROUP BY specialty)""",
    """SELECT 'by_reason', CAST(row_number() OVER (ORDER BY n DESC, denial_code) AS BIGINT), denial_code, NULL, n
FROM (SELECT denial_code, count(*) AS n FROM stg WHERE is_denied GROUP BY denial_code)""",
])


@C.product("trend_document_blocks", "G13 G14 G15 O8 S3", O.with_claims(_TREND_SQL))
def q_trend_document_blocks(spark, sf_dir):
    from claimlens.sinks.publish import new_scratch, publish_json, trend_document
    from claimlens.sources.files import TREND_DOC_SCHEMA, read_report

    s, sd = C.stg(spark, sf_dir), C.seed(spark)
    b = denials.report_blocks(recovery.with_recovery(s, sd), sd)
    path = publish_json(trend_document(b["kpi"], b["monthly"], b["by_payer"], b["by_reason"], b["by_specialty"]), new_scratch(spark, "trend_report"))
    doc = read_report(spark, path, TREND_DOC_SCHEMA)

    def block(name: str, entry: str, rate: str, n: str) -> DataFrame:
        return doc.select(F.posexplode(name)).selectExpr(f"'{name}' AS block", "CAST(pos + 1 AS BIGINT) AS place", f"{entry} AS entry", f"{rate} AS rate", f"CAST({n} AS BIGINT) AS n")

    return (block("by_payer", "col.payer", "col.denial_rate_pct", "col.total_claims").unionByName(block("by_specialty", "col.specialty", "col.denial_rate_pct", "col.total_claims"))
            .unionByName(block("by_reason", "col.denial_code", "CAST(NULL AS DOUBLE)", "col.count")))


# ---------------------------------------------------------------------------
# the write path, and the remaining tenant reads

def incoming_batch(records: DataFrame, cutoff: str) -> DataFrame:
    """A batch that meets every rule: records from the cutoff on, even
    numbers sent by a writer of their organization; with missing insurers,
    negative charges, unknown statuses, missing remits, shared references,
    references that the store has, and rows that outsiders send a second time."""
    k = _k("external_ref")
    writer = F.when(F.col("org_id") == 0, 15).otherwise(F.col("org_id") * 6 % 15).cast("bigint")  # such a user is an admin there
    base = records.filter((F.col("service_date") >= F.lit(cutoff).cast("date")) | (k % 40 == 6)).withColumn("k", k)
    sent = base.withColumns({
        "submitted_by": F.when(F.col("k") % 2 == 0, writer).otherwise(F.col("submitted_by")),
        "insurer_name": F.when(F.col("k") % 40 != 2, F.col("insurer_name")),
        "charge_amount": F.when(F.col("k") % 40 == 4, -F.col("charge_amount")).otherwise(F.col("charge_amount")),
        "record_status": F.when(F.col("k") % 40 == 8, "void").otherwise(F.col("record_status")),
        "remit_amount": F.when(F.col("k") % 40 != 10, F.col("remit_amount")),
        "external_ref": F.when(F.col("k") % 40 == 12, F.concat(F.lit("DUP-"), (F.col("k") % 97).cast("string"))).otherwise(F.col("external_ref")),
    })
    again = sent.filter(F.col("k") % 40 == 14).withColumn("submitted_by", F.lit(2).cast("bigint"))  # user 2 is a viewer
    return sent.unionByName(again).drop("k")


@C.product("tenant_append_batch", "K6 Q6 RL4 Q1 Q2 Q3 Q4", O.with_claims(f"""
SELECT org_id, external_ref, submitted_by, CAST(remit_amount AS DOUBLE) AS remit_amount,
       CASE WHEN bad IS NOT NULL THEN bad
            WHEN count(*) FILTER (bad IS NULL) OVER (PARTITION BY org_id, external_ref) > 1 THEN 'duplicate_in_batch'
            WHEN (org_id, external_ref) IN (SELECT (org_id, external_ref) FROM records WHERE service_date < DATE '{C.APPEND_CUTOFF}') THEN 'already_exists' END AS reject_reason
FROM (
  SELECT *, CASE WHEN (submitted_by, org_id) NOT IN (SELECT (user_id, org_id) FROM users WHERE user_role <> 'viewer') THEN 'not_writer'
                 WHEN insurer_name IS NULL THEN 'null_field' WHEN charge_amount < 0 THEN 'negative_amount'
                 WHEN record_status = 'void' THEN 'bad_status' END AS bad
  FROM (
    SELECT org_id, if(k % 40 = 12, 'DUP-' || (k % 97), external_ref) AS external_ref, if(k % 40 = 2, NULL, insurer_name) AS insurer_name,
           if(k % 40 = 4, -charge_amount, charge_amount) AS charge_amount, if(k % 40 = 10, 0, remit_amount) AS remit_amount,
           if(k % 40 = 8, 'void', record_status) AS record_status,
           unnest(CASE WHEN k % 40 = 14 THEN [if(org_id = 0, 15, org_id * 6 % 15), 2] WHEN k % 2 = 0 THEN [if(org_id = 0, 15, org_id * 6 % 15)]
                       ELSE [submitted_by] END) AS submitted_by
    FROM (SELECT *, {_SQL_K.format("external_ref")} AS k FROM records)
    WHERE service_date >= DATE '{C.APPEND_CUTOFF}' OR k % 40 = 6))""", O.TENANT))
def q_tenant_append_batch(spark, sf_dir):
    """Defaults, checks and the write: accepted and rejected rows are read back from what was written."""
    from claimlens.sinks.publish import append_claim_records, new_scratch

    r = C.records(spark, sf_dir)
    checked = tenant.append_batch(incoming_batch(r, C.APPEND_CUTOFF), C.users(spark, sf_dir), r.filter(F.col("service_date") < F.lit(C.APPEND_CUTOFF).cast("date")))
    path = new_scratch(spark, "append")
    checked.write.parquet(f"{path}/checked")
    checked = spark.read.parquet(f"{path}/checked")
    accepted = checked.filter("reject_reason IS NULL").drop("reject_reason")
    append_claim_records(accepted, f"{path}/store")
    stored = spark.read.schema(accepted.schema).parquet(f"{path}/store").withColumn("reject_reason", F.lit(None).cast("string"))
    return checked.filter("reject_reason IS NOT NULL").unionByName(stored).select(
        "org_id", "external_ref", "submitted_by", F.col("remit_amount").cast("double").alias("remit_amount"), "reject_reason")


@C.product("tenant_read_organizations", "RL2", O.with_claims(f"""
SELECT org_id, org_name FROM orgs WHERE org_id IN (SELECT org_id FROM users WHERE user_id = {C.TENANT_USER})""", O.TENANT))
def q_tenant_read_organizations(spark, sf_dir):
    return tenant.scoped_read(fixture.organizations(spark, sf_dir), C.users(spark, sf_dir), C.TENANT_USER).select("org_id", "org_name")


@C.product("tenant_read_runs", "K5 RL2 X18", O.with_claims(f"""
SELECT org_id, n_opportunities, true AS has_id_and_time
FROM orgs, (SELECT count(*) AS n_opportunities FROM opp) p
WHERE org_id IN (SELECT org_id FROM users WHERE user_id = {C.TENANT_USER})""", O.TENANT + "," + O.OPP))
def q_tenant_read_runs(spark, sf_dir):
    """Append a run for every organization, then read those that the user may see."""
    from claimlens.sinks.commits import Store
    from claimlens.sinks.publish import append_run, new_scratch

    store = Store(spark, new_scratch(spark, "runs"))
    stored = append_run(spark, store, fixture.organizations(spark, sf_dir), recovery.recovery_summary(C.stg(spark, sf_dir), C.seed(spark)), dt.datetime.combine(C.A, dt.time(6)))
    runs = tenant.scoped_read(stored, C.users(spark, sf_dir), C.TENANT_USER)
    return runs.select("org_id", F.get_json_object("summary_payload", "$.n_opportunities").cast("bigint").alias("n_opportunities"),
                       (F.length("run_id").eqNullSafe(36) & F.col("run_at").isNotNull()).alias("has_id_and_time"))


@C.product("records_listing", "K7 O3", O.with_claims("""
SELECT org_id, external_ref, service_date, insurer_name, CAST(charge_amount AS DOUBLE) AS charge_amount, record_status FROM records""", O.TENANT))
def q_records_listing(spark, sf_dir):
    """All records in order of service date."""
    r = C.records(spark, sf_dir)
    return r.select("org_id", "external_ref", "service_date", "insurer_name", F.col("charge_amount").cast("double").alias("charge_amount"), "record_status").orderBy("service_date", "external_ref")


@C.product("recovery_by_seed_csv", "S2 G19", O.with_claims("""
SELECT category, reason, CAST(round(sum(recovery_potential), 2) AS DOUBLE) AS recovery_potential, count(*) AS claim_count FROM opp GROUP BY category, reason""", O.OPP))
def q_recovery_by_seed_csv(spark, sf_dir):
    """Recovery by reason, the appeal rates read from a seed file."""
    from claimlens.sinks.publish import new_scratch
    from claimlens.sources.files import read_seed_csv

    path = new_scratch(spark, "seed_csv")
    C.seed(spark).write.option("header", True).csv(path)
    return recovery.recovery_by(C.stg(spark, sf_dir), read_seed_csv(spark, path), ["category", "reason"])


@C.product("denial_rate_plain", "G2 J1 O1", C.REGISTRY["denial_rate_by_payer_12m"].oracle)
def q_denial_rate_plain(spark, sf_dir):
    """The rate by payer with the join before the aggregate."""
    return denials.denial_rate_by_payer(C.wh(spark, sf_dir), C.payers(spark, sf_dir), C.A, C.PARAMS.trailing_months, pre_aggregate=False)


# ---------------------------------------------------------------------------
# edges of the fixture

def edge_claims(stg: DataFrame) -> DataFrame:
    """Staged claims with payer 'NATION_4' without open claims, days in
    quarters, unknown codes, and claims without a payer."""
    k = _k("claim_id")
    settled = (F.col("payer") == "NATION_4") & F.col("is_open_ar")
    d = stg.filter(~settled)
    return d.withColumns({
        "days_to_resolve": F.col("days_to_resolve") + (k % 4) / 4,
        "denial_code": F.when((k % 7 == 0) & F.col("is_denied"), "ZZ-9").otherwise(F.col("denial_code")),
        "payer": F.when(k % 41 != 0, F.col("payer")),
    })


_EDGE = f""",
stg AS (
  SELECT * REPLACE (days_to_resolve + (k % 4) / 4.0 AS days_to_resolve, if(k % 7 = 0 AND is_denied, 'ZZ-9', denial_code) AS denial_code,
                    if(k % 41 = 0, NULL, payer) AS payer)
  FROM (SELECT *, {_SQL_K.format("claim_id")} AS k FROM staged) WHERE NOT (payer = 'NATION_4' AND is_open_ar)
)"""


def _on_edges(body: str, ctes: str) -> str:
    plain = O.with_claims(body, "@@")
    return plain.replace("stg AS (", "staged AS (", 1).replace(",@@", _EDGE + "," + ctes, 1)


@C.product("payer_scorecard_edges", "G9 T8 T10 T21", _on_edges("SELECT * FROM scorecard", O.SCORE))
def q_payer_scorecard_edges(spark, sf_dir):
    return scorecard.payer_scorecard(edge_claims(C.stg(spark, sf_dir)), C.A)


@C.product("recovery_by_reason_edges", "G19 T16", _on_edges("""
SELECT category, reason, CAST(round(sum(recovery_potential), 2) AS DOUBLE) AS recovery_potential, count(*) AS claim_count FROM opp GROUP BY category, reason""", O.OPP))
def q_recovery_by_reason_edges(spark, sf_dir):
    return recovery.recovery_by(edge_claims(C.stg(spark, sf_dir)), C.seed(spark), ["category", "reason"])


@C.product("reason_breakdown_edges", "G14 T16", _on_edges("""
SELECT denial_code, CAST(n AS BIGINT) AS claim_count, CAST(round(lost, 2) AS DOUBLE) AS billed_lost, denial_reason_label AS label
FROM (SELECT denial_code, count(*) AS n, sum(billed_amount) AS lost FROM stg WHERE is_denied GROUP BY denial_code) LEFT JOIN seed USING (denial_code)""", "one AS (SELECT 1)"))
def q_reason_breakdown_edges(spark, sf_dir):
    return denials.reason_breakdown(edge_claims(C.stg(spark, sf_dir)), C.seed(spark))


@C.product("equal_metric_scorecard", "G9 T7", _on_edges("SELECT * FROM scorecard", O.SCORE).replace(
    "NOT (payer = 'NATION_4' AND is_open_ar)", "is_denied"))
def q_equal_metric_scorecard(spark, sf_dir):
    """Denied claims only: every payer's denial rate is 100, so no score can be made."""
    k = _k("claim_id")
    d = C.stg(spark, sf_dir).filter("is_denied").withColumns({
        "days_to_resolve": F.col("days_to_resolve") + (k % 4) / 4, "payer": F.when(k % 41 != 0, F.col("payer"))})
    return scorecard.payer_scorecard(d, C.A)
