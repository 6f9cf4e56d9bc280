"""Property tests (hypothesis): Spark column rules vs plain-Python models of
the same rule, on random inputs with many ties and edge values. Each property
collects one small frame per example, so the example counts stay low."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.functions.bands import aging_bucket, confidence, grade
from claimlens.functions.rounding import rpt
from claimlens.operators.ranking import distributed_row_number

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def py_bucket(d):
    if d is None:
        return "90+"
    for edge, label in zip(P.AGING_EDGES, P.AGING_BUCKETS):
        if d <= edge:
            return label
    return P.AGING_BUCKETS[-1]


def py_grade(score):
    if score is None:
        return "D"
    for edge, label in P.GRADE_EDGES:
        if score >= edge:
            return label
    return "D"


def py_confidence(rate):
    for edge, label in P.CONFIDENCE_EDGES:
        if rate >= edge:
            return label
    return "Low"


@SETTINGS
@given(st.lists(st.decimals(min_value=-10_000, max_value=10_000, places=4, allow_nan=False), min_size=1, max_size=40))
def test_report_rounding_is_decimal_half_up(spark, values):
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").cast("decimal(12,4)").alias("v"))
    got = [r[0] for r in df.select(rpt("v", 1)).collect()]
    want = [float(v.quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)) for v in values]
    assert got == want


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-5, max_value=400)), min_size=1, max_size=60))
def test_aging_bucket_matches_model(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "d int")
    assert [r[0] for r in df.select(aging_bucket("d")).collect()] == [py_bucket(d) for d in days]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.decimals(min_value=0, max_value=100, places=1)), min_size=1, max_size=60),
       st.lists(st.sampled_from([0.0, 0.05, 0.24, 0.25, 0.28, 0.35, 0.49, 0.5, 0.55, 0.65]), min_size=1, max_size=20))
def test_grade_and_confidence_match_model(spark, scores, rates):
    df = spark.createDataFrame([(None if s is None else float(s),) for s in scores], "s double")
    assert [r[0] for r in df.select(grade("s")).collect()] == [py_grade(None if s is None else float(s)) for s in scores]
    rf = spark.createDataFrame([(r,) for r in rates], "r double")
    assert [x[0] for x in rf.select(confidence("r")).collect()] == [py_confidence(r) for r in rates]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(min_value=0, max_value=5), min_size=1, max_size=300), st.integers(min_value=1, max_value=9))
def test_distributed_row_number_matches_sorted_order(spark, values, parts):
    rows = [(f"k{i:05d}", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, v double")
    order = [F.desc("v"), F.asc("key")]
    got = {r["key"]: r["rn"] for r in distributed_row_number(df.repartition(parts), order, "rn").collect()}
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
