"""Sinks (K1-K6): views, mart tables, published report documents, appends.

Report documents are built from report-sized frames (one row per payer,
bucket, reason, or the top-k list) with ONE aggregate over a tagged union of
their rows, so no join or driver-side assembly is needed; only the final
one-row document is written.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.operators.aging import BUCKET_COLUMNS
from claimlens.operators.tenant import append_batch
from claimlens.session import scratch_path
from claimlens.sinks.commits import Entry, Store, content_name, entries_since, has_batch

PUBLISHED_BUCKETS = ["0-30", "31-60", "61-90", "90+"]


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """K2: materialise as parquet (full refresh by default), optionally
    partitioned (claims by month so date filters prune files)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def _by(keys: list[str]):
    """Comparator of structs: each key ascending, or descending with a leading "-"."""
    def compare(a, b):
        out = F.lit(0)
        for key in reversed(keys):
            k = key.lstrip("-")
            less, more = (1, -1) if key.startswith("-") else (-1, 1)
            out = F.when(a[k] < b[k], less).when(a[k] > b[k], more).otherwise(out)
        return out

    return compare


def _document(parts: dict[str, DataFrame], singles: dict[str, DataFrame], sort_keys: dict[str, list[str]]) -> DataFrame:
    """One-row document: each ``parts`` frame becomes an array of structs
    (sorted by its ``sort_keys``), each ``singles`` frame (one row)
    becomes a struct. Built with one aggregate over the tagged union."""
    tagged = []
    for name, df in {**parts, **singles}.items():
        tagged.append(df.select(F.struct(*df.columns).alias(name)))
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    aggs = []
    for name in parts:
        aggs.append(F.array_sort(F.collect_list(name), _by(sort_keys[name])).alias(name))
    for name in singles:
        aggs.append(F.first(name, ignorenulls=True).alias(name))
    return union.agg(*aggs)


def scorecard_document(scorecard: DataFrame, matrix: DataFrame, summary: DataFrame, as_of) -> DataFrame:
    """K3: {as_of_date, summary{6}, scorecard[n]{10}, aging_matrix[n]{5}}."""
    sc = scorecard.select(
        F.col("payer_rank").alias("rank"),
        "payer",
        "grade",
        "composite_score",
        F.col("denial_rate_pct").alias("denial_rate"),
        F.col("underpay_rate_pct").alias("underpay_rate"),
        "avg_days_to_resolve",
        "pct_ar_90plus",
        "total_billed",
        "total_paid",
    )
    am = matrix.select("payer", *[F.col(c).alias(b) for c, b in zip(BUCKET_COLUMNS, PUBLISHED_BUCKETS)])
    doc = _document({"scorecard": sc, "aging_matrix": am}, {"summary": summary}, {"scorecard": ["rank"], "aging_matrix": ["payer"]})
    return doc.select(F.lit(str(as_of)).alias("as_of_date"), "summary", "scorecard", "aging_matrix")


def recovery_document(
    summary: DataFrame, top: DataFrame, by_payer: DataFrame, by_specialty: DataFrame, by_reason: DataFrame
) -> DataFrame:
    """K4: {summary{6}, top25[k]{12}, by_payer, by_specialty, by_reason}."""
    top = top.select(*[F.col(c).cast("string") if c == "claim_date" else F.col(c) for c in top.columns])
    bp = by_payer.select("payer", "recovery_potential")
    bs = by_specialty.select("specialty", "recovery_potential")
    br = by_reason.select("category", "reason", F.col("recovery_potential").alias("total_recovery"), "claim_count")
    doc = _document(
        {"top25": top, "by_payer": bp, "by_specialty": bs, "by_reason": br},
        {"summary": summary},
        {"top25": ["rank"], "by_payer": ["-recovery_potential", "payer"], "by_specialty": ["-recovery_potential", "specialty"],
         "by_reason": ["-total_recovery", "category", "reason"]},
    )
    return doc.select("summary", "top25", "by_payer", "by_specialty", "by_reason")


def publish_json(doc: DataFrame, path: str) -> str:
    """Write a one-row document as a single JSON file under ``path``."""
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def new_scratch(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, f"{kind}/{uuid.uuid4().hex}")


RUN_SCHEMA = "run_id string, org_id int, run_at timestamp, summary_payload string"


def append_run(spark: SparkSession, store: Store, org_ids: DataFrame, payload: DataFrame, run_at: dt.datetime) -> DataFrame:
    """K5: one run per org with an opaque JSON payload (``payload`` is a one-row
    frame; it is serialised with ``to_json`` and broadcast to the org rows).

    A run's id is a name-based UUID of (org, time, payload), so a task that
    is run again writes the same id, and the same call made twice is the same
    batch and is in the store once. Returns the runs as the store has them."""
    if len(payload.take(2)) != 1:
        raise ValueError("a run payload must be exactly one row")
    p = payload.select(F.to_json(F.struct(*payload.columns)).alias("summary_payload"), F.lit(1).alias("_k"))
    runs = org_ids.select(F.col("org_id").cast("int").alias("org_id"), F.lit(1).alias("_k")).join(F.broadcast(p), "_k").select(
        "org_id", F.lit(run_at).cast("timestamp").alias("run_at"), "summary_payload")
    runs = runs.select(_name_uuid(F.concat_ws("\n", F.col("org_id").cast("string"), F.unix_micros("run_at").cast("string"), "summary_payload")).alias("run_id"), *runs.columns)
    store.append(runs, content_name(runs))
    return read_runs(store)


def read_runs(store: Store) -> DataFrame:
    """The store's runs, each id once."""
    return store.read(schema=T.StructType.fromDDL(RUN_SCHEMA)).dropDuplicates(["run_id"])


def _name_uuid(name: Column) -> Column:
    """A version-3 UUID (MD5) of a text."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def append_claim_records(accepted: DataFrame, path: str) -> str:
    """Append accepted rows to a plain folder, partitioned by org: the layout
    alone. :func:`append_records` adds the key rule for writers at once."""
    # rows of one organization meet in few tasks, a large one's are split by size
    accepted.hint("rebalance", "org_id").write.mode("append").partitionBy("org_id").parquet(path)
    return path


def append_records(batch: DataFrame, users: DataFrame, store: Store, schema: T.StructType) -> tuple[Entry | None, DataFrame]:
    """K6: the rows of ``batch`` that may be written, under the unique (org_id,
    external_ref) key, however many writers there are. Returns the log entry
    (None: this batch is in the store already, or nothing in it may be written)
    and the checked rows with their ``reject_reason``.

    Optimistic: rows are checked against the store as it was read and staged;
    the entry is published only if no version has come between. Otherwise the
    staged rows are checked against the folders committed since, and only what
    is left is staged again: the store is never checked from the start twice."""
    spark, name = batch.sparkSession, content_name(batch)
    log = store.entries()
    if has_batch(log, name):
        return None, spark.createDataFrame([], T.StructType([*batch.schema.fields, T.StructField("reject_reason", T.StringType())]))
    checked = append_batch(batch, users, store.read(as_of=log, schema=schema))
    path = new_scratch(spark, "checked")
    checked.write.parquet(path)
    checked = spark.read.schema(checked.schema).parquet(path)
    told = {"rows": json.dumps(schema.jsonValue())}
    state = {"seen": log, "left": checked.filter("reject_reason IS NULL").select(*schema.fieldNames()), "folder": None}

    def make(now: list[Entry]) -> Entry | None:
        if has_batch(now, name):
            return None
        since = entries_since(state["seen"], now)
        if since:
            # a replacement (a compaction, say) may hold rows of any version: then all of it is looked at
            taken = store.read(as_of=since, schema=schema).select("org_id", "external_ref")
            state["left"], state["folder"] = state["left"].join(taken, ["org_id", "external_ref"], "left_anti").select(*schema.fieldNames()), None
        state["seen"] = now
        if state["folder"] is None:
            # rows of one organization meet in few tasks, a large one's are split by size
            state["folder"] = store.stage(state["left"].hint("rebalance", "org_id"), "rows", ["org_id"])
        return Entry(now[-1].version + 1 if now else 0, False, {"rows": [state["folder"]]}, told, name)

    entry = store.commit(make)
    if entry is None:
        return None, checked
    written = store.read(as_of=[entry], schema=schema).select("org_id", "external_ref", F.lit(True).alias("_in"))
    told_now = checked.join(written, ["org_id", "external_ref"], "left").withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(F.col("_in").isNull(), "already_exists")))
    return entry, told_now.select(*checked.columns)


def trend_document(kpi: DataFrame, monthly: DataFrame, by_payer: DataFrame, by_reason: DataFrame,
                   by_specialty: DataFrame) -> DataFrame:
    """The denial-trend report object: {kpi{7}, monthly[m], by_payer[p],
    by_reason[r], by_specialty[s]}; months as 'YYYY-MM' text, as published."""
    from claimlens.functions.fmt import month_key

    m = monthly.select(month_key("claim_month").alias("claim_month"), "total_claims", "denied", "underpaid_amt",
                       "billed", "denial_rate_pct")
    r = by_reason.select("denial_code", F.col("claim_count").alias("count"), "billed_lost", "label")
    doc = _document(
        {"monthly": m, "by_payer": by_payer, "by_reason": r, "by_specialty": by_specialty},
        {"kpi": kpi},
        {"monthly": ["claim_month"], "by_payer": ["-denial_rate_pct", "payer"], "by_reason": ["-count", "denial_code"],
         "by_specialty": ["-denial_rate_pct", "specialty"]},
    )
    return doc.select("kpi", "monthly", "by_payer", "by_reason", "by_specialty")
