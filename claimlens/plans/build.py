"""The end-to-end build (stage -> marts -> tests -> publish), as one plan.

1. Stage the raw extract once and write it as parquet partitioned by
   ``claim_month`` (rebalanced by month first: AQE sizes the write tasks, so
   each task writes few folders and a hot month is split across tasks).
   Every mart then reads that table: lineage is cut, date filters prune
   month folders, and column pruning reaches the files.
2. Aggregate the staged claims once, at the finest grain that any mart or
   document needs (``plans/cube.py``), and write that. The trend, aging and
   scorecard marts and all document blocks add its rows up; only the ranked
   opportunities read claims again. Marts are written ``threads`` at a time.
3. Run the schema tests of staged claims and marts (failing-row counts).
4. Write the three report documents (scorecard, recovery, denial trend),
   check the first two against the marts, and publish the build: all its
   tables and documents replace the ones before in one log entry.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.operators import aging, denials, quality, recovery, scorecard, staging
from claimlens.plans.cube import claim_cube, rolled
from claimlens.session import ensure_checkpoint_dir
from claimlens.sinks import publish
from claimlens.sinks.commits import Store
from claimlens.sources import fixture
from claimlens.sources.files import RECOVERY_DOC_SCHEMA, SCORECARD_DOC_SCHEMA, read_report


@dataclass
class BuildResult:
    paths: dict
    test_failures: DataFrame
    scorecard_check: DataFrame
    recovery_check: DataFrame


def stage_to_table(raw: DataFrame, path: str, keep: tuple[str, ...] = ("payer_id",)) -> DataFrame:
    """Write staged claims partitioned by month and return a reader on it.

    The ``rebalance`` hint hash-distributes rows by month and lets AQE size
    the write tasks from the data: small months are coalesced, and a hot
    month (even a third of all claims) is split into ~advisory-size pieces,
    so each task writes few, evenly sized files."""
    spark = raw.sparkSession
    stg = staging.stg_claims(raw, keep=list(keep))
    laid_out = stg.hint("rebalance", "claim_month")
    publish.write_table(laid_out, path, partition_by=["claim_month"])
    # read back with the written schema (no partition-type inference)
    return spark.read.schema(stg.schema).parquet(path)


def mart_tests(trend: DataFrame, ar: DataFrame, score: DataFrame, opp: DataFrame, seed: DataFrame) -> DataFrame:
    """The mart schema tests: unique / not_null / accepted_values, as
    (model, check, column_name, failures) rows; one aggregate pass per table."""
    parts = [
        quality.profile("monthly_denial_trend", trend, unique="claim_month",
                        not_null=["claim_month", "denial_rate_pct"]),
        quality.profile("ar_aging_decision", ar, not_null=["aging_bucket"], accepted={"aging_bucket": P.AGING_BUCKETS}),
        quality.profile("payer_scorecard", score, unique="payer", not_null=["payer", "composite_score"],
                        accepted={"grade": P.GRADES}),
        quality.profile("recovery_opportunities", opp, unique="claim_id",
                        not_null=["claim_id", "recovery_potential"], accepted={"category": P.CATEGORIES}),
        quality.profile("appeal_success_rates", seed, unique="denial_code", not_null=["denial_code"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _concurrently(jobs: dict[str, Callable[[], str]], threads: int) -> dict[str, str]:
    """Submit independent Spark jobs from a small thread pool (the scheduler
    shares the executors between them) and return their results by name."""
    if threads <= 1:
        return {name: job() for name, job in jobs.items()}
    with ThreadPoolExecutor(max_workers=threads) as pool:
        futures = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


def build_all(spark: SparkSession, sf_dir: str, out_dir: str, as_of: dt.date = P.FIXTURE_AS_OF,
              threads: int = 4, keep: int = 2) -> BuildResult:
    """Stage, build and write the marts (independent marts and documents are
    written concurrently, ``threads`` at a time), test, publish, check.

    ``out_dir`` is a committed store: every table and document goes into a new
    folder, and one log entry, published last, replaces all of them at once.
    A build that fails midway leaves the one before readable
    (:func:`read_mart`); ``keep`` builds stay on disk."""
    store = Store(spark, out_dir)
    paths, schemas = {}, {}

    def write(name: str, df: DataFrame) -> str:
        schemas[name] = df.schema
        return f"{out_dir}/{store.stage(df, name)}"

    raw = fixture.raw_claims(spark, sf_dir)
    paths["stg_claims"] = f"{out_dir}/{store.new_folder('stg_claims')}"
    stg = stage_to_table(raw, paths["stg_claims"])
    schemas["stg_claims"] = stg.schema
    seed = recovery.appeal_rates(spark)

    paths["claim_cube"] = write("claim_cube", claim_cube(recovery.with_recovery(stg, seed), as_of))
    cube = spark.read.parquet(paths["claim_cube"])  # one scan of the claims feeds all of what follows but the ranked list
    core = core_marts_of(rolled(cube, CORE_SETS, CORE_KEYS, CORE_MEASURES))
    frame = core.pop("scorecard_frame")
    marts = {name: (lambda df=df: df) for name, df in core.items()}
    marts["recovery_opportunities"] = lambda: recovery.recovery_opportunities(stg, seed)
    paths.update(_concurrently(
        {name: (lambda name=name, make=make: write(name, make())) for name, make in marts.items()},
        threads,
    ))
    read = {name: spark.read.parquet(p) for name, p in paths.items() if name != "stg_claims"}

    # staged-claims schema tests (one pass) + the mart and seed tests
    staged_tests = quality.profile("stg_claims", stg, unique="claim_id",
                                   not_null=["claim_id", "status", "billed_amount", "payer"],
                                   accepted={"status": P.STATUSES})
    tests = staged_tests.unionByName(mart_tests(read["monthly_denial_trend"], read["ar_aging_decision"],
                                                read["payer_scorecard"], read["recovery_opportunities"], seed))

    matrix = aging.matrix_from_counts(read["ar_aging_decision"])
    sdoc = publish.scorecard_document(read["payer_scorecard"], matrix, aging.ar_summary(frame), as_of)
    rblocks = recovery.recovery_blocks_of(rolled(cube, [["payer"], ["specialty"], ["category", "reason"], []], recovery.REC_KEYS, {
        "_s": "rec", "_n": "opportunities", "_h": "rec_high", "_u": "rec_under", "_a": "rec_appeal", "_b": "billed"}))
    summary = rblocks["summary"]
    top = recovery.top_of(read["recovery_opportunities"], P.Params().top_k)
    rdoc = publish.recovery_document(summary, top, rblocks["by_payer"], rblocks["by_specialty"], rblocks["by_reason"])
    blocks = denials.report_blocks_of(rolled(cube, [[k] for k in denials.BLOCK_KEYS] + [[]], denials.BLOCK_KEYS, {
        "total_claims": "claims", "denied": "denied", "_u": "underpaid", "_under": "gap", "_billed": "billed", "_paid": "paid", "_lost": "lost",
        "_rec": "rec", "_days": "mean_days"}), seed)
    tdoc = publish.trend_document(blocks["kpi"], blocks["monthly"], blocks["by_payer"], blocks["by_reason"],
                                  blocks["by_specialty"])
    paths.update(_concurrently({
        "scorecard_doc": lambda: publish.publish_json(sdoc, f"{out_dir}/{store.new_folder('scorecard_report')}"),
        "recovery_doc": lambda: publish.publish_json(rdoc, f"{out_dir}/{store.new_folder('recovery_report')}"),
        "trend_doc": lambda: publish.publish_json(tdoc, f"{out_dir}/{store.new_folder('trend_report')}"),
    }, threads))

    published_sc = read_report(spark, paths["scorecard_doc"], SCORECARD_DOC_SCHEMA).select(F.inline("scorecard"))
    sc_check = quality.scorecard_diff(read["payer_scorecard"], published_sc)
    published_rec = read_report(spark, paths["recovery_doc"], RECOVERY_DOC_SCHEMA).select("summary.*")
    rec_check = quality.recovery_diff(summary, published_rec)
    store.publish_refresh({name: [p[len(out_dir) + 1 :]] for name, p in paths.items()}, schemas)
    store.expire(keep)
    return BuildResult(paths, tests, sc_check, rec_check)


def read_mart(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A table of the newest finished build at ``out_dir``."""
    return Store(spark, out_dir).read(name)


CORE_KEYS = ["claim_month", "payer", "bucket"]
CORE_SETS = [["claim_month"], ["payer"], ["payer", "bucket"]]
CORE_MEASURES = {"total_claims": "claims", "_billed": "billed", "_paid": "paid", "_d": "denied", "_u": "underpaid", "_days": "mean_days",
                 "ar_claims": "open", "ar_claims_90plus": "old", "ar_billed": "open_billed", "ar_billed_90plus": "old_billed"}


def core_marts_of(g: DataFrame) -> dict[str, DataFrame]:
    """The monthly-trend, AR-aging and payer-scorecard marts, and the scored
    per-payer frame, from grouping-set rows over CORE_KEYS, which are
    checkpointed (one row per group) and split by ``grouping_id``."""
    ensure_checkpoint_dir(g.sparkSession)
    g = g.checkpoint(eager=True)
    gid = F.col("_gid")
    months = g.filter(gid == 0b011).select("claim_month", F.col("total_claims").alias("n"), F.col("_d").alias("d"))
    buckets = g.filter((gid == 0b100) & F.col("bucket").isNotNull()).select(
        "payer", F.col("bucket").alias("aging_bucket"), F.col("ar_claims").alias("n"), F.col("ar_billed").alias("s")
    )
    frame = scorecard.score(scorecard.per_payer_from(g.filter(gid == 0b101)))
    return {
        "monthly_denial_trend": denials.trend_from_counts(months),
        "ar_aging_decision": aging.aging_from_counts(buckets),
        "payer_scorecard": scorecard.scorecard_report(frame),
        "scorecard_frame": frame,
    }


def core_marts(stg: DataFrame, seed: DataFrame, as_of: dt.date = P.FIXTURE_AS_OF) -> dict[str, DataFrame]:
    """:func:`core_marts_of` straight from staged claims, in one scan. Equal
    to ``monthly_denial_trend``, ``ar_aging`` and ``payer_scorecard``."""
    return core_marts_of(rolled(claim_cube(recovery.with_recovery(stg, seed), as_of), CORE_SETS, CORE_KEYS, CORE_MEASURES))
