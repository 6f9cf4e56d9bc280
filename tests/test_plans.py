"""t4: plan assertions (what the physical plan must and must not contain)."""

import pytest
from pyspark.sql import functions as F

from claimlens import catalog
from claimlens.operators import denials, recovery
from claimlens.operators.ranking import distributed_row_number
from claimlens.plans.inspect import physical_plan

from conftest import SF_MID, SF_SMALL


def test_underpayment_detection_is_a_hash_join_not_nested_loop(spark):
    plan = physical_plan(catalog.REGISTRY["underpayment_detection"].fn(spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan or "SortMergeJoin" in plan


def test_seed_join_is_broadcast(spark):
    for df in (recovery.opportunities(catalog.stg(spark, SF_SMALL), recovery.appeal_rates(spark)),
               denials.reason_breakdown(catalog.stg(spark, SF_SMALL), recovery.appeal_rates(spark))):
        plan = physical_plan(df)
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert "BroadcastHashJoin LeftOuter" in plan


def test_recovery_rank_has_no_single_partition_exchange_over_claims(spark):
    df = catalog.REGISTRY["recovery_opportunities"].fn(spark, SF_SMALL)
    plan = physical_plan(df)
    # the only un-partitioned window is over the per-partition counts
    # (n rows, inside the broadcast side); the claim-grain stream side has no
    # exchange at all (it reads the checkpointed range partitions)
    tree = plan.split("\n\n")[0]
    stream_side = tree.split("BroadcastExchange")[0]
    assert "Exchange" not in stream_side
    assert "SinglePartition" not in stream_side


def test_scan_is_pruned_and_filter_pushed(spark, tmp_path):
    stg = catalog.stg(spark, SF_SMALL)
    path = str(tmp_path / "stg")
    stg.write.partitionBy("claim_month").parquet(path)
    staged = spark.read.parquet(path)
    df = denials.denial_rate_by_payer(staged, catalog.payers(spark, SF_SMALL), catalog.A, 12)
    plan = physical_plan(df)
    assert "GreaterThanOrEqual(claim_date" in plan  # row-group filter pushed into the scan
    part = [ln for ln in plan.splitlines() if ln.startswith("PartitionFilters")]
    assert part and "claim_month" in part[0]  # month folders outside the window are skipped
    # only the needed columns are read
    scan = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema") and "claim_date" in ln][0]
    assert "billed_amount" not in scan and "denial_reason" not in scan


def test_aggregations_are_partial_before_shuffle(spark):
    plan = physical_plan(catalog.REGISTRY["payer_scorecard"].fn(spark, SF_SMALL))
    assert "partial_count" in plan


@pytest.mark.parametrize("hot_share", [0.0, 0.34])
def test_distributed_row_number_equals_window(spark, hot_share):
    from pyspark.sql import Window

    n = 5000
    df = spark.range(n).select(
        F.format_string("k%06d", "id").alias("key"),
        F.when(F.col("id") < int(n * hot_share), F.lit(1.0)).otherwise((F.col("id") * 7919 % 1000).cast("double")).alias("v"),
    )
    order = [F.desc("v"), F.asc("key")]
    a = distributed_row_number(df, order, "rn")
    b = df.withColumn("rn2", F.row_number().over(Window.orderBy(*order)))
    j = a.join(b, "key")
    assert j.count() == n
    assert j.filter("rn != rn2").count() == 0
    assert "SinglePartition" not in physical_plan(a).split("BroadcastExchange")[0]


def test_distributed_row_number_on_opportunities_matches_window(spark):
    from pyspark.sql import Window

    opp = recovery.opportunities(catalog.stg(spark, SF_MID), recovery.appeal_rates(spark))
    a = distributed_row_number(opp, recovery.rank_order(), "rn")
    b = opp.withColumn("rn2", F.row_number().over(Window.orderBy(*recovery.rank_order())))
    assert a.join(b.select("claim_id", "rn2"), "claim_id").filter("rn != rn2").count() == 0


def test_no_product_plans_a_cartesian_or_nested_loop_join(spark):
    bad = {}
    for name, prod in catalog.REGISTRY.items():
        plan = physical_plan(prod.fn(spark, SF_SMALL))
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_report_blocks_equal_products_and_read_claims_once(spark):
    from claimlens.sinks.publish import trend_document

    s, sd = catalog.stg(spark, SF_SMALL), recovery.appeal_rates(spark)
    b = denials.report_blocks(recovery.with_recovery(s, sd), sd)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(b["monthly"]) == rows(denials.monthly_breakdown(s))
    assert rows(b["by_payer"]) == rows(denials.payer_breakdown(s))
    assert rows(b["by_specialty"]) == rows(denials.specialty_breakdown(s).drop("severity"))
    assert rows(b["by_reason"]) == rows(denials.reason_breakdown(s, sd))
    assert rows(b["kpi"]) == rows(denials.kpi_denial(recovery.with_recovery(s, sd)))
    doc = trend_document(b["kpi"], b["monthly"], b["by_payer"], b["by_reason"], b["by_specialty"])
    tree = physical_plan(doc).split("\n\n")[0]
    assert "Scan parquet" not in tree  # the blocks read the checkpointed aggregate
    assert tree.count("Scan ExistingRDD") == 5


def test_core_marts_from_one_scan_equal_the_standalone_marts(spark):
    from claimlens.operators import aging, scorecard
    from claimlens.plans.build import core_marts

    s = catalog.stg(spark, SF_SMALL)
    m = core_marts(s, recovery.appeal_rates(spark), catalog.A)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(m["monthly_denial_trend"]) == rows(denials.monthly_denial_trend(s))
    assert rows(m["ar_aging_decision"]) == rows(aging.ar_aging(s, catalog.A))
    assert rows(m["payer_scorecard"]) == rows(scorecard.payer_scorecard(s, catalog.A))
    for df in m.values():  # all three read the checkpointed aggregate, not the claims
        assert "Scan parquet" not in physical_plan(df).split("\n\n")[0]


def test_recovery_blocks_from_one_scan_equal_the_products(spark):
    s, sd = catalog.stg(spark, SF_SMALL), recovery.appeal_rates(spark)
    b = recovery.recovery_blocks(s, sd)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(b["summary"]) == rows(recovery.recovery_summary(s, sd))
    assert rows(b["by_payer"]) == rows(recovery.recovery_by(s, sd, ["payer"]))
    assert rows(b["by_specialty"]) == rows(recovery.recovery_by(s, sd, ["specialty"]))
    assert rows(b["by_reason"]) == rows(recovery.recovery_by(s, sd, ["category", "reason"]))


BOUNDED_INPUTS = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject",
                  "Scan ExistingRDD", "LocalTableScan")
PASS_THROUGH = ("Project", "Filter", "Sort", "ColumnarToRow", "InputAdapter", "WholeStageCodegen", "Exchange",
                "AQEShuffleRead", "ShuffleQueryStage")


def single_partition_inputs(plan: str) -> list[str]:
    """For each SinglePartition exchange of a formatted plan, the first
    operator below it that is not a pass-through (project/filter/sort)."""
    import re

    tree, _, details = plan.partition("\n\n")
    single = set(re.findall(r"\((\d+)\) Exchange\s*\nInput[^\n]*\nArguments: SinglePartition", details))
    lines = [ln for ln in tree.splitlines() if re.search(r"\(\d+\)", ln)]
    found = []
    for i, ln in enumerate(lines):
        m = re.search(r"Exchange \((\d+)\)", ln)
        if not m or m.group(1) not in single:
            continue
        for child in lines[i + 1:]:
            name = re.sub(r"^[\s:|+\-*]*", "", child).split(" (")[0].strip()
            if not name.startswith(PASS_THROUGH):
                found.append(name)
                break
    return found


def test_single_partition_exchanges_only_carry_bounded_inputs(spark):
    bad = {}
    for name, prod in catalog.REGISTRY.items():
        inputs = single_partition_inputs(physical_plan(prod.fn(spark, SF_SMALL)))
        wrong = [x for x in inputs if not x.startswith(BOUNDED_INPUTS)]
        if wrong:
            bad[name] = wrong
    assert bad == {}


def test_single_partition_check_flags_claim_grain_windows(spark):
    from pyspark.sql import Window

    s = catalog.stg(spark, SF_SMALL)
    naive = s.withColumn("rn", F.row_number().over(Window.orderBy("claim_id")))
    inputs = single_partition_inputs(physical_plan(naive))
    assert inputs and not all(x.startswith(BOUNDED_INPUTS) for x in inputs)
