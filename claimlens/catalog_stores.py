"""Products over committed stores, keyed tables, inferred documents, landed
extracts, slicers, pages and guarded lookups.

As in ``catalog_checks``, faults are made by rules over ``k``, the number in a
claim's id, and the oracle SQL states the same rules.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens import catalog as C
from claimlens import oracle as O
from claimlens import params as P
from claimlens.catalog_checks import _SQL_K, _k, incoming_batch
from claimlens.operators import denials, lookup, paging, recovery, scorecard, slicers
from claimlens.sinks import commits, keyed, publish
from claimlens.sinks.publish import new_scratch, publish_json
from claimlens.sources import drift, extract, fixture
from claimlens.sources.files import RAW_CLAIMS_SCHEMA, SCORECARD_DOC_SCHEMA

# ---------------------------------------------------------------------------
# J5 scalar lookups


@C.product("underpayment_lookup", "J5 G5", O.with_claims("""
SELECT claim_id, payer_id, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(paid_amount AS DOUBLE) AS paid_amount, CAST(rate AS DOUBLE) AS expected_rate,
       CAST(round(rate * billed_amount - paid_amount, 2) AS DOUBLE) AS underpayment_gap
FROM (SELECT c.*, (SELECT er.expected_rate FROM rates er WHERE er.payer_id = c.payer_id AND er.specialty = c.specialty) AS rate
      FROM warehouse c WHERE claim_status = 'Paid')
WHERE paid_amount < rate * billed_amount * 0.95""", """
rates AS (SELECT DISTINCT payer_id, specialty, expected_rate FROM claims)"""))
def q_underpayment_lookup(spark, sf_dir):
    """Underpaid claims by their one contracted rate."""
    return recovery.underpayment_lookup(C.wh(spark, sf_dir), fixture.expected_rates(spark, sf_dir), C.PARAMS.underpayment_tolerance)


def doubled_rates(rates: DataFrame) -> DataFrame:
    """Contracted rates with a second one for each payer divisible by 5 (automobile and
    building specialties), and one for a payer that no claim has."""
    again = rates.filter((F.col("payer_id") % 5 == 0) & F.col("specialty").isin("AUTOMOBILE", "BUILDING"))
    stranger = rates.filter("payer_id = 1 AND specialty = 'BUILDING'").withColumn("payer_id", F.lit(99))
    return rates.unionByName(again).unionByName(stranger).unionByName(stranger)


@C.product("rate_conflicts", "J5 Q1", O.with_claims("""
SELECT payer_id, specialty, CAST(2 AS BIGINT) AS matches, count(*) AS facts FROM warehouse
WHERE claim_status = 'Paid' AND payer_id % 5 = 0 AND specialty IN ('AUTOMOBILE', 'BUILDING') GROUP BY ALL"""))
def q_rate_conflicts(spark, sf_dir):
    """Which lookups a rate table with doubled rates would make fail, and for how many claims."""
    paid = C.wh(spark, sf_dir).filter(F.col("status") == P.STATUS_PAID)
    return lookup.lookup_conflicts(paid, doubled_rates(fixture.expected_rates(spark, sf_dir)), ["payer_id", "specialty"])


# ---------------------------------------------------------------------------
# K6, K5, K2 committed stores

_RECORDS_BEFORE = f"service_date < DATE '{C.APPEND_CUTOFF}'"


@C.product("tenant_append_retry", "K6 Q1 RL4", O.with_claims(f"""
SELECT org_id, external_ref, CAST(charge_amount AS DOUBLE) AS charge_amount, CAST(1 AS BIGINT) AS copies FROM records WHERE {_RECORDS_BEFORE}
UNION ALL
SELECT org_id, 'NEW-' || external_ref, CAST(charge_amount AS DOUBLE), 1 FROM records
WHERE NOT {_RECORDS_BEFORE} AND (SELECT k % 3 FROM (SELECT {_SQL_K.format("external_ref")} AS k)) < 2
  AND (submitted_by, org_id) IN (SELECT (user_id, org_id) FROM users WHERE user_role <> 'viewer')""", O.TENANT))
def q_tenant_append_retry(spark, sf_dir):
    """A store after a batch was sent twice, and a second batch that has a third of its
    keys in common: every key is there once, with the charge that came first."""
    r = C.records(spark, sf_dir)
    late = r.filter(F.col("service_date") >= F.lit(C.APPEND_CUTOFF).cast("date")).withColumn("external_ref", F.concat(F.lit("NEW-"), "external_ref"))
    k = _k("external_ref") % 3
    first, second = late.filter(k == 0), late.filter(k < 2).withColumn("charge_amount", F.when(k == 0, F.col("charge_amount") + 1).otherwise(F.col("charge_amount")).cast("decimal(12,2)"))
    store = commits.Store(spark, new_scratch(spark, "records"))
    store.append(r.filter(F.col("service_date") < F.lit(C.APPEND_CUTOFF).cast("date")), "initial", partition_by=["org_id"])
    for batch in (first, first, second):
        publish.append_records(batch, C.users(spark, sf_dir), store, r.schema)
    out = store.read(schema=r.schema)
    return out.groupBy("org_id", "external_ref").agg(F.min("charge_amount").cast("double").alias("charge_amount"), F.count(F.lit(1)).alias("copies"))


@C.product("marts_after_failed_refresh", "K2 G9 Q7", O.with_claims("""
SELECT *, CAST(0 AS BIGINT) AS version FROM scorecard""", O.SCORE))
def q_marts_after_failed_refresh(spark, sf_dir):
    """The scorecard as readers see it after a second refresh wrote its folder but stopped before it was published."""
    s = C.stg(spark, sf_dir)
    store = commits.Store(spark, new_scratch(spark, "marts"))
    store.refresh({"payer_scorecard": scorecard.payer_scorecard(s, C.A), "denial_trend": denials.monthly_denial_trend(s)})
    store.stage(scorecard.payer_scorecard(s.filter(~F.col("is_denied")), C.A), "payer_scorecard")
    return store.read("payer_scorecard").withColumn("version", F.lit(store.version()).cast("bigint"))


@C.product("marts_after_refresh", "K2 G7", O.with_claims(f"""
SELECT claim_month, count(*) AS claims_submitted, CAST(1 AS BIGINT) AS version FROM stg WHERE is_denied GROUP BY claim_month"""))
def q_marts_after_refresh(spark, sf_dir):
    """A table that was refreshed twice: only the second state is read, and an old folder can go."""
    s = C.stg(spark, sf_dir)
    store = commits.Store(spark, new_scratch(spark, "marts"))
    by_month = lambda df: df.groupBy("claim_month").agg(F.count(F.lit(1)).alias("claims_submitted"))
    store.refresh({"months": by_month(s)})
    store.refresh({"months": by_month(s.filter("is_denied"))})
    store.expire(keep=1)
    return store.read("months").withColumn("version", F.lit(store.version()).cast("bigint"))


@C.product("runs_appended_twice", "K5 X18", O.with_claims("""
SELECT org_id, CAST(1 AS BIGINT) AS runs, n AS n_opportunities, TIMESTAMP '2001-08-02 06:00:00' AS run_at
FROM orgs, (SELECT count(*) AS n FROM opp)""", O.TENANT + "," + O.OPP))
def q_runs_appended_twice(spark, sf_dir):
    """Runs per organization after the same run was appended twice."""
    store = commits.Store(spark, new_scratch(spark, "runs"))
    orgs, payload = fixture.organizations(spark, sf_dir), recovery.recovery_summary(C.stg(spark, sf_dir), C.seed(spark))
    for _ in range(2):
        runs = publish.append_run(spark, store, orgs, payload, dt.datetime(2001, 8, 2, 6))
    return runs.groupBy("org_id", F.get_json_object("summary_payload", "$.n_opportunities").cast("bigint").alias("n_opportunities"), F.col("run_at").cast("timestamp_ntz").alias("run_at")).agg(
        F.countDistinct("run_id").alias("runs"))


# ---------------------------------------------------------------------------
# S3 inferred documents

def altered_document(doc: DataFrame) -> DataFrame:
    """The published scorecard with a field less, one more, one of another type, and one renamed, at several depths."""
    entry = lambda x: F.struct(*[x[f] for f in ("rank", "payer", "composite_score", "denial_rate", "underpay_rate", "avg_days_to_resolve", "total_billed", "total_paid")],
                               F.concat(x["pct_ar_90plus"].cast("string"), F.lit(" %")).alias("pct_ar_90plus"), F.lit("v2").alias("method"))
    return doc.withColumns({
        "scorecard": F.transform("scorecard", entry),
        "summary": F.struct("summary.total_ar_outstanding", "summary.ar_90plus", "summary.ar_90plus_pct", F.col("summary.n_payers").cast("string").alias("n_payers"),
                            F.col("summary.best_payer").alias("top_payer"), "summary.worst_payer"),
        "generated_by": F.struct(F.lit("monthly job").alias("job"), F.array(F.lit(1), F.lit(2)).alias("steps")),
    }).drop("as_of_date")


def _altered(spark, sf_dir) -> DataFrame:
    _, doc = C._published_scorecard(spark, sf_dir)
    return drift.infer_document(spark, publish_json(altered_document(doc), new_scratch(spark, "altered_report")))


@C.product("report_schema_drift", "S3", """
SELECT * FROM (VALUES
  ('as_of_date', 'missing', 'string', NULL), ('summary.best_payer', 'missing', 'string', NULL), ('summary.top_payer', 'extra', NULL, 'string'),
  ('summary.n_payers', 'retyped', 'bigint', 'string'), ('scorecard[].grade', 'missing', 'string', NULL), ('scorecard[].method', 'extra', NULL, 'string'),
  ('scorecard[].pct_ar_90plus', 'retyped', 'double', 'string'), ('generated_by', 'extra', NULL, 'struct<job:string,steps:array<bigint>>')) AS d(path, kind, expected, found)""")
def q_report_schema_drift(spark, sf_dir):
    """Where an altered report, its schema inferred, differs from the contract."""
    return drift.schema_drift(spark, _altered(spark, sf_dir).schema, SCORECARD_DOC_SCHEMA)


@C.product("report_conformed", "S3 P8 P9", O.with_claims("""
SELECT payer_rank AS rank, payer, CAST(NULL AS VARCHAR) AS grade, composite_score, denial_rate_pct AS denial_rate, underpay_rate_pct AS underpay_rate,
       avg_days_to_resolve, CAST(NULL AS DOUBLE) AS pct_ar_90plus, total_billed, total_paid FROM scorecard""", O.SCORE))
def q_report_conformed(spark, sf_dir):
    """The altered report's scorecard in the contract's shape: what is gone or retyped is NULL."""
    return drift.unnest(drift.conform(_altered(spark, sf_dir), SCORECARD_DOC_SCHEMA), "scorecard")


# ---------------------------------------------------------------------------
# Q1, K6 keys without moving the claims

def claims_by_key(spark, sf_dir) -> DataFrame:
    """Staged claims bucketed and sorted by claim_id, written once per session and input."""
    return C.ref(spark, sf_dir, "claims_by_key", lambda: keyed.write_keyed(C.stg(spark, sf_dir), ["claim_id"], new_scratch(spark, "claims_by_key")))


def dirty_by_key(spark, sf_dir) -> DataFrame:
    """Claims with every 109th twice and every 113th without an id, by key."""
    def write():
        k = _k("claim_id")
        d = C.stg(spark, sf_dir).select("claim_id", "payer", "billed_amount")
        d = d.unionByName(d.filter(k % 109 == 0)).withColumn("claim_id", F.when(k % 113 != 0, F.col("claim_id")))
        return keyed.write_keyed(d, ["claim_id"], new_scratch(spark, "dirty_by_key"))

    return C.ref(spark, sf_dir, "dirty_by_key", write)


@C.product("dq_unique_keyed", "Q1", O.with_claims(f"""
SELECT claim_id, CAST(2 AS BIGINT) AS occurrences FROM (SELECT claim_id, {_SQL_K.format("claim_id")} AS k FROM stg) WHERE k % 109 = 0 AND k % 113 <> 0"""))
def q_dq_unique_keyed(spark, sf_dir):
    """Repeated claim ids, found bucket by bucket."""
    return keyed.repeated_keys(dirty_by_key(spark, sf_dir), ["claim_id"])


@C.product("claims_known_by_key", "Q1 K6 J3", O.with_claims(f"""
SELECT external_ref, count(*) AS rows, k % 40 <> 12 AS exists FROM (
  SELECT if(k % 40 = 12, 'DUP-' || (k % 97), external_ref) AS external_ref, k % 40 AS k, unnest(range(if(k % 40 = 14, 2, 1))) AS copy
  FROM (SELECT *, {_SQL_K.format("external_ref")} AS k FROM records) WHERE service_date >= DATE '{C.APPEND_CUTOFF}' OR k % 40 = 6)
GROUP BY external_ref, k % 40 <> 12""", O.TENANT))
def q_claims_known_by_key(spark, sf_dir):
    """Which references of an incoming batch are claims already, looked up in their buckets."""
    batch = incoming_batch(C.records(spark, sf_dir), C.APPEND_CUTOFF).select(F.col("external_ref").alias("claim_id"), "org_id")
    known = keyed.known_keys(batch, claims_by_key(spark, sf_dir), ["claim_id"])
    return known.groupBy(F.col("claim_id").alias("external_ref"), "exists").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------------------
# F9 slicers

_PERIOD_SQL = "strftime(claim_date - INTERVAL 6 MONTH, '%Y')"
_PERIOD_TEXT = f"concat({_PERIOD_SQL}, '-07 ', CAST({_PERIOD_SQL} AS INTEGER) + 1, '-06')"
_SLICED = f"""
sliced AS (
  SELECT s.*, {_PERIOD_TEXT} AS period, o.recovery_potential, CAST(days_to_resolve AS DECIMAL(12,4)) AS days
  FROM stg s LEFT JOIN (SELECT claim_id, recovery_potential FROM opp) o USING (claim_id)
)"""


def slices(spark, sf_dir) -> DataFrame:
    """The slicer cube, written once per session and input."""
    s, sd = C.stg(spark, sf_dir), C.seed(spark)
    return C.ref(spark, sf_dir, "slicer_cube", lambda: slicers.write_cube(slicers.slice_cube(recovery.with_recovery(s, sd)), new_scratch(spark, "slicer_cube")))


@C.product("slicer_cube", "F9 G11 A10", O.with_claims(f"""
SELECT CAST(grouping_id(payer, specialty, period) AS INTEGER) AS slicers, payer, specialty, period, count(*) AS total_claims,
       CAST(coalesce(round(sum(billed_amount), 0), 0) AS DOUBLE) AS total_billed, CAST(coalesce(round(sum(paid_amount), 0), 0) AS DOUBLE) AS total_paid,
       {O.r("100.0 * count(*) FILTER (is_denied) / count(*)")} AS denial_rate, {O.r("100.0 * count(*) FILTER (is_underpaid) / count(*)")} AS underpay_rate,
       CAST(coalesce(round(sum(recovery_potential), 0), 0) AS DOUBLE) AS total_recoverable, {O.r("sum(days) / count(days)")} AS avg_days_to_resolve
FROM sliced GROUP BY CUBE (payer, specialty, period)""", O.OPP + "," + _SLICED))
def q_slicer_cube(spark, sf_dir):
    """The KPI strip of every combination of payer, specialty and period, "all" included."""
    return slicers.kpis(slices(spark, sf_dir))


@C.product("payer_slices", "F9 G11", O.with_claims(f"""
SELECT payer, count(*) AS total_claims, {O.r("100.0 * count(*) FILTER (is_denied) / count(*)")} AS denial_rate,
       CAST(coalesce(round(sum(recovery_potential), 0), 0) AS DOUBLE) AS total_recoverable
FROM sliced WHERE payer IN ('NATION_11', 'NATION_12') AND period = '1996-07 1997-06' GROUP BY payer""", O.OPP + "," + _SLICED))
def q_payer_slices(spark, sf_dir):
    """Two payers in one period, all specialties, read from the cube by key."""
    cube = slices(spark, sf_dir)
    a, b = (slicers.kpis(slicers.slice_of(cube, payer=p, period="1996-07 1997-06")) for p in ("NATION_11", "NATION_12"))
    return a.unionByName(b).select("payer", "total_claims", "denial_rate", "total_recoverable")


@C.product("payer_slice_trend", "F9 G7 W2", O.with_claims(f"""
SELECT claim_month, n AS claims_submitted, d AS denied_claims, CAST(rate AS DOUBLE) AS denial_rate_pct,
       CAST(lag(rate) OVER (ORDER BY claim_month) AS DOUBLE) AS prior_month_rate_pct, {O.r("rate - lag(rate) OVER (ORDER BY claim_month)")} AS mom_change_pts
FROM (SELECT claim_month, count(*) AS n, count(*) FILTER (is_denied) AS d, {O.rd("100.0 * count(*) FILTER (is_denied) / count(*)")} AS rate
      FROM stg WHERE payer = 'NATION_11' AND specialty = 'BUILDING' GROUP BY claim_month)"""))
def q_payer_slice_trend(spark, sf_dir):
    """The monthly trend of one payer and specialty, from the cube by month."""
    s, sd = C.stg(spark, sf_dir), C.seed(spark)
    cube = C.ref(spark, sf_dir, "slicer_months", lambda: slicers.write_cube(slicers.slice_cube(recovery.with_recovery(s, sd), by_month=True), new_scratch(spark, "slicer_months")))
    months = slicers.slice_of(cube, payer="NATION_11", specialty="BUILDING")  # all periods
    return slicers.trend(months)


# ---------------------------------------------------------------------------
# S1 extracts with bad lines

def extract_lines(raw: DataFrame) -> DataFrame:
    """An extract as text lines with planted faults: amounts and dates that are
    none, missing ids and payers, unknown statuses, fields too many and too few."""
    k = _k("claim_id")
    fields = {f.name: F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in RAW_CLAIMS_SCHEMA.fields}
    fields["billed_amount"] = F.when(k % 211 == 0, "n/a").otherwise(fields["billed_amount"])
    fields["claim_date"] = F.when(k % 223 == 0, "1996-13-45").otherwise(fields["claim_date"])
    fields["payer"] = F.when(k % 227 == 0, "").otherwise(fields["payer"])
    fields["status"] = F.when(k % 229 == 0, "Lost").otherwise(fields["status"])
    fields["claim_id"] = F.when(k % 233 == 0, "").otherwise(fields["claim_id"])
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) if n == "denial_reason" else c for n, c in fields.items()]
    line = F.concat_ws(",", *quoted)
    line = F.when(k % 239 == 0, F.concat(line, F.lit(",extra"))).when(k % 241 == 0, F.concat_ws(",", *quoted[:4])).otherwise(line)
    return raw.select(line.alias("value"))


def _landed(spark, sf_dir) -> extract.Landed:
    def land():
        path = new_scratch(spark, "extract_csv")
        extract_lines(C.stg(spark, sf_dir).select(*RAW_CLAIMS_SCHEMA.fieldNames())).write.text(path)
        return extract.land_extract(spark, path, new_scratch(spark, "extract"), RAW_CLAIMS_SCHEMA, ["claim_id", "claim_date", "payer", "billed_amount", "status"],
                                    {"status": P.STATUSES}, header=False)

    return C.ref(spark, sf_dir, "landed_extract", land)


_BAD = """
faults AS (
  SELECT *, CASE WHEN k % 239 = 0 OR k % 241 = 0 THEN ['columns'] ELSE list_filter([
      if(k % 233 = 0, 'missing:claim_id', NULL), if(k % 223 = 0, 'type:claim_date', NULL), if(k % 227 = 0, 'missing:payer', NULL),
      if(k % 211 = 0, 'type:billed_amount', NULL), if(k % 229 = 0, 'value:status', NULL)], lambda x: x IS NOT NULL) END AS reasons
  FROM (SELECT *, """ + _SQL_K.format("claim_id") + """ AS k FROM stg)
)"""


@C.product("extract_rejects", "S1 Q2 Q3", O.with_claims("""
SELECT array_to_string(reasons, ' ') AS reasons, if(reasons = ['columns'], 'line', 'fields') AS kept_as, count(*) AS lines,
       count(*) FILTER (k % 239 = 0) AS too_long
FROM faults WHERE len(reasons) > 0 GROUP BY ALL""", _BAD))
def q_extract_rejects(spark, sf_dir):
    """The refused lines of an extract by their reasons; lines of another shape are kept as they came."""
    r = _landed(spark, sf_dir).rejected
    return r.groupBy(F.array_join("reasons", " ").alias("reasons"), F.when(F.col(extract.CORRUPT).isNotNull(), "line").otherwise("fields").alias("kept_as")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col(extract.CORRUPT).endswith(",extra")).alias("too_long"))


@C.product("extract_accepted", "S1 X1", O.with_claims("""
SELECT claim_id, claim_date, CAST(payer_id AS INTEGER) AS payer_id, payer, specialty, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(paid_amount AS DOUBLE) AS paid_amount,
       status, denial_code, denial_reason, days_to_resolve, CAST(underpayment_gap AS DOUBLE) AS underpayment_gap
FROM faults WHERE len(reasons) = 0""", _BAD))
def q_extract_accepted(spark, sf_dir):
    """The accepted lines of an extract, typed, row by row."""
    a = _landed(spark, sf_dir).accepted
    return a.withColumns({c: F.col(c).cast("double") for c in ("billed_amount", "paid_amount", "underpayment_gap")})


@C.product("extract_differences", "S1 J10", O.with_claims("""
SELECT claim_id, 'left' AS side FROM faults WHERE len(reasons) > 0""", _BAD))
def q_extract_differences(spark, sf_dir):
    """Staged claims against what the extract landed, all columns compared: only the refused lines are missing."""
    landed = _landed(spark, sf_dir).accepted
    staged = C.stg(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_CLAIMS_SCHEMA.fields])
    return extract.differences(staged, landed, ["claim_id"]).select("claim_id", "side")


# ---------------------------------------------------------------------------
# K7 pages

PAGE_ROWS = 500


def listing_of(spark, sf_dir) -> paging.Listing:
    """The records laid out for paging, written once per session and input."""
    r = C.records(spark, sf_dir)
    return C.ref(spark, sf_dir, "records_listing", lambda: paging.lay_out(r, new_scratch(spark, "records_listing")))


@C.product("records_pages", "K7 O3", O.with_claims(f"""
SELECT CAST(row_number() OVER (ORDER BY service_date, external_ref) AS BIGINT) AS place,
       CAST((row_number() OVER (ORDER BY service_date, external_ref) - 1) // {PAGE_ROWS} + 1 AS BIGINT) AS page, org_id, external_ref, service_date
FROM records""", O.TENANT))
def q_records_pages(spark, sf_dir):
    """Every record with its place in the order of service dates, and its page."""
    rows = listing_of(spark, sf_dir).placed()
    return rows.select(F.col("place").cast("bigint").alias("place"), F.expr(f"cast((place - 1) div {PAGE_ROWS} + 1 as bigint)").alias("page"), "org_id", "external_ref", "service_date")


@C.product("records_page_after", "K7 O3", O.with_claims(f"""
SELECT CAST(row_number() OVER (ORDER BY service_date, external_ref) AS BIGINT) AS place, external_ref, service_date
FROM records WHERE (service_date, external_ref) > (SELECT (max(service_date), max(external_ref)) FROM records WHERE service_date < DATE '1996-01-01')
QUALIFY place <= {PAGE_ROWS}""", O.TENANT))
def q_records_page_after(spark, sf_dir):
    """The page after a cursor: the largest date before 1996 and the largest reference of such dates."""
    listing = listing_of(spark, sf_dir)
    cursor = listing.rows.filter("service_date < DATE '1996-01-01'").agg(F.max("service_date"), F.max("external_ref")).first()
    page = listing.page(PAGE_ROWS, (cursor[0], cursor[1]))
    in_order = Window.orderBy("service_date", "external_ref")  # one page
    return page.select("external_ref", "service_date", F.row_number().over(in_order).cast("bigint").alias("place"))
