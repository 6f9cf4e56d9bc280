"""RL1-RL5: tenant scoping of reads and appends, as DataFrame transforms.

A user belongs to one or more organizations (``app_users``); a user reads the
rows of their organizations, reads their own profile, and may append claim
records only into organizations where they are ``admin`` or ``analyst``.
Every other (table, action) pair is denied.

Scale notes: every join is written plainly; Catalyst and AQE choose its
form from measured bytes (a user's few organizations come out as a broadcast,
and a user who submits a large share of a batch as a split partition).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import params as P


def orgs_of(users: DataFrame, user_id) -> DataFrame:
    """RL1: org ids of one user (a table function: one row per org)."""
    return users.filter(F.col("user_id") == F.lit(user_id)).select("org_id").distinct()


def scoped_read(table: DataFrame, users: DataFrame, user_id) -> DataFrame:
    """RL2: rows of ``table`` (which has ``org_id``) visible to the user."""
    return table.join(orgs_of(users, user_id), "org_id", "left_semi")


def own_profile(users: DataFrame, user_id) -> DataFrame:
    """RL3: the user's own row(s)."""
    return users.filter(F.col("user_id") == F.lit(user_id))


def _writers(users: DataFrame) -> DataFrame:
    return users.filter(F.col("user_role").isin(*P.WRITER_ROLES)).select(
        F.col("user_id").alias("submitted_by"), "org_id"
    )


def append_accepted(batch: DataFrame, users: DataFrame) -> DataFrame:
    """RL4: rows of ``batch`` (with ``submitted_by`` and ``org_id``) whose
    organization has the submitting user as admin or analyst."""
    return batch.join(_writers(users), ["submitted_by", "org_id"], "left_semi")


def append_rejected(batch: DataFrame, users: DataFrame) -> DataFrame:
    """RL4: the complement of :func:`append_accepted` (NULL user or org
    never matches, so such rows are rejected)."""
    return batch.join(_writers(users), ["submitted_by", "org_id"], "left_anti")


def allowed(table: str, action: str) -> bool:
    """RL5: deny by default; only the listed (table, action) pairs pass."""
    return (table, action) in P.ALLOWED_ACTIONS


def split_requests(requests: DataFrame) -> DataFrame:
    """RL5 over a frame of requests (table_name, action): adds ``allowed``."""
    ok = None
    for t, a in sorted(P.ALLOWED_ACTIONS):
        cond = (F.col("table_name") == t) & (F.col("action") == a)
        ok = cond if ok is None else (ok | cond)
    return requests.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def visibility_summary(records: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: how many records and charged dollars they can read.

    Records are first reduced to one row per org, so the join to users is
    (users x 1) rows, never users x records."""
    per_org = records.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), F.sum("charge_amount").alias("c"))
    return users.select("user_id", "org_id").join(per_org, "org_id", "left").select(
        "user_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("visible_records"),
        F.coalesce(F.round("c", 2), F.lit(0)).cast("double").alias("visible_charges"),
    )


WRITE_ACTIONS = ["insert", "update", "delete"]
TENANT_TABLES = ["organizations", "app_users", "claim_records", "report_runs"]


def denied_writes(users: DataFrame) -> DataFrame:
    """RL4 + RL5 as a permission matrix: for every user, each write action on
    each tenant table that is denied. A write passes only if the policy
    allows the (table, action) pair and, for claim inserts, the user is an
    admin or analyst (the per-row org check is :func:`append_accepted`).

    Each user row is expanded with a generator over the fixed 12 (table,
    action) pairs — a per-row explode, not a join."""
    pairs = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(a).alias("action"))
                      for t in TENANT_TABLES for a in WRITE_ACTIONS])
    x = users.select("user_id", "user_role", F.inline(pairs))
    policy = None
    for t, a in sorted(P.ALLOWED_ACTIONS):
        cond = (F.col("table_name") == t) & (F.col("action") == a)
        policy = cond if policy is None else (policy | cond)
    writer = F.col("user_role").isin(*P.WRITER_ROLES)
    ok = policy & F.when(F.col("action") == "insert", writer).otherwise(F.lit(True))
    return x.filter(~F.coalesce(ok, F.lit(False))).select("user_id", "table_name", "action")


REQUIRED_RECORD_FIELDS = ["org_id", "external_ref", "service_date", "procedure_code", "insurer_name",
                          "charge_amount", "record_status"]


#: Q6: what the store fills in where a batch leaves it out
RECORD_DEFAULTS = {"remit_amount": 0}


def validate_append(batch: DataFrame, users: DataFrame, existing: DataFrame) -> DataFrame:
    """K6 checks before an append: ``batch`` plus ``reject_reason`` (NULL =
    accepted). In order of precedence: ``not_writer`` (RL4), ``null_field``,
    ``negative_amount``, ``bad_status`` (Q2-Q4), ``duplicate_in_batch`` and
    ``already_exists`` (the unique (org_id, external_ref) key, Q1).

    Only rows that pass the earlier checks count as duplicates, so nobody can
    block another tenant's row by sending its key. The store is reduced to
    the batch's keys by a semi join before anything is grouped."""
    key = ["org_id", "external_ref"]
    writers = _writers(users).select("submitted_by", "org_id", F.lit(True).alias("_writer")).distinct()
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED_RECORD_FIELDS])
    negative = (F.col("charge_amount") < 0) | (F.coalesce(F.col("remit_amount"), F.lit(0)) < 0)
    first = (
        F.when(F.col("_writer").isNull(), "not_writer")
        .when(any_null, "null_field")
        .when(negative, "negative_amount")
        .when(~F.col("record_status").isin(*P.RECORD_STATUSES), "bad_status")
    )
    checked = batch.join(writers, ["submitted_by", "org_id"], "left").withColumn("_first", first)
    asked = checked.filter(F.col("_first").isNull()).groupBy(*key).agg((F.count(F.lit(1)) > 1).alias("_dup"))
    held = existing.select(*key).join(asked.select(*key), key, "left_semi").distinct().withColumn("_exists", F.lit(True))
    j = checked.join(asked.join(held, key, "left"), key, "left")
    reason = F.coalesce("_first", F.when(F.col("_dup"), "duplicate_in_batch").when(F.col("_exists"), "already_exists"))
    return j.withColumn("reject_reason", reason).select(*batch.columns, "reject_reason")


def append_batch(batch: DataFrame, users: DataFrame, existing: DataFrame) -> DataFrame:
    """The whole write path before the write: defaults (Q6), then checks."""
    from claimlens.operators.quality import with_defaults

    return validate_append(with_defaults(batch, RECORD_DEFAULTS), users, existing)
