"""File and database sources (S1-S5) with explicit schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The raw claim extract (landing table), one row per claim.
RAW_CLAIMS_SCHEMA = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("claim_date", T.DateType()),
        T.StructField("payer_id", T.IntegerType()),
        T.StructField("payer", T.StringType()),
        T.StructField("specialty", T.StringType()),
        T.StructField("billed_amount", T.DecimalType(12, 2)),
        T.StructField("paid_amount", T.DecimalType(12, 2)),
        T.StructField("status", T.StringType()),
        T.StructField("denial_code", T.StringType()),
        T.StructField("denial_reason", T.StringType()),
        T.StructField("days_to_resolve", T.DoubleType()),
        T.StructField("underpayment_gap", T.DecimalType(12, 2)),
    ]
)

# The appeal-rate seed; the rate column type is pinned to double.
SEED_SCHEMA = T.StructType(
    [
        T.StructField("denial_code", T.StringType()),
        T.StructField("denial_reason_label", T.StringType()),
        T.StructField("appeal_success_rate", T.DoubleType()),
    ]
)

# S3: published report documents.
SCORECARD_ROW = T.StructType(
    [
        T.StructField("rank", T.LongType()),
        T.StructField("payer", T.StringType()),
        T.StructField("grade", T.StringType()),
        T.StructField("composite_score", T.DoubleType()),
        T.StructField("denial_rate", T.DoubleType()),
        T.StructField("underpay_rate", T.DoubleType()),
        T.StructField("avg_days_to_resolve", T.DoubleType()),
        T.StructField("pct_ar_90plus", T.DoubleType()),
        T.StructField("total_billed", T.DoubleType()),
        T.StructField("total_paid", T.DoubleType()),
    ]
)
AGING_ROW = T.StructType(
    [T.StructField("payer", T.StringType())]
    + [T.StructField(b, T.DoubleType()) for b in ("0-30", "31-60", "61-90", "90+")]
)
SCORECARD_DOC_SCHEMA = T.StructType(
    [
        T.StructField("as_of_date", T.StringType()),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("total_ar_outstanding", T.DoubleType()),
                    T.StructField("ar_90plus", T.DoubleType()),
                    T.StructField("ar_90plus_pct", T.DoubleType()),
                    T.StructField("n_payers", T.LongType()),
                    T.StructField("best_payer", T.StringType()),
                    T.StructField("worst_payer", T.StringType()),
                ]
            ),
        ),
        T.StructField("scorecard", T.ArrayType(SCORECARD_ROW)),
        T.StructField("aging_matrix", T.ArrayType(AGING_ROW)),
    ]
)
TOP_ROW = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("claim_date", T.StringType()),
        T.StructField("payer", T.StringType()),
        T.StructField("specialty", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("billed", T.DoubleType()),
        T.StructField("current_paid", T.DoubleType()),
        T.StructField("recovery_potential", T.DoubleType()),
        T.StructField("recovery_confidence", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("rank", T.LongType()),
    ]
)
RECOVERY_DOC_SCHEMA = T.StructType(
    [
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("total_recovery_potential", T.DoubleType()),
                    T.StructField("high_confidence_recovery", T.DoubleType()),
                    T.StructField("underpayment_recovery", T.DoubleType()),
                    T.StructField("appeal_recovery", T.DoubleType()),
                    T.StructField("n_opportunities", T.LongType()),
                    T.StructField("total_billed_universe", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("top25", T.ArrayType(TOP_ROW)),
        T.StructField(
            "by_payer",
            T.ArrayType(T.StructType([T.StructField("payer", T.StringType()), T.StructField("recovery_potential", T.DoubleType())])),
        ),
        T.StructField(
            "by_specialty",
            T.ArrayType(
                T.StructType([T.StructField("specialty", T.StringType()), T.StructField("recovery_potential", T.DoubleType())])
            ),
        ),
        T.StructField(
            "by_reason",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("category", T.StringType()),
                        T.StructField("reason", T.StringType()),
                        T.StructField("total_recovery", T.DoubleType()),
                        T.StructField("claim_count", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


TREND_DOC_SCHEMA = T.StructType(
    [
        T.StructField("kpi", T.StructType([
            T.StructField("total_claims", T.LongType()), T.StructField("total_billed", T.DoubleType()),
            T.StructField("total_paid", T.DoubleType()), T.StructField("denial_rate", T.DoubleType()),
            T.StructField("underpay_rate", T.DoubleType()), T.StructField("total_recoverable", T.DoubleType()),
            T.StructField("avg_days_to_resolve", T.DoubleType())])),
        T.StructField("monthly", T.ArrayType(T.StructType([
            T.StructField("claim_month", T.StringType()), T.StructField("total_claims", T.LongType()),
            T.StructField("denied", T.LongType()), T.StructField("underpaid_amt", T.DoubleType()),
            T.StructField("billed", T.DoubleType()), T.StructField("denial_rate_pct", T.DoubleType())]))),
        T.StructField("by_payer", T.ArrayType(T.StructType([
            T.StructField("payer", T.StringType()), T.StructField("total_claims", T.LongType()),
            T.StructField("denied", T.LongType()), T.StructField("underpaid_amt", T.DoubleType()),
            T.StructField("billed", T.DoubleType()), T.StructField("paid", T.DoubleType()),
            T.StructField("denial_rate_pct", T.DoubleType())]))),
        T.StructField("by_reason", T.ArrayType(T.StructType([
            T.StructField("denial_code", T.StringType()), T.StructField("count", T.LongType()),
            T.StructField("billed_lost", T.DoubleType()), T.StructField("label", T.StringType())]))),
        T.StructField("by_specialty", T.ArrayType(T.StructType([
            T.StructField("specialty", T.StringType()), T.StructField("total_claims", T.LongType()),
            T.StructField("denied", T.LongType()), T.StructField("underpaid_amt", T.DoubleType()),
            T.StructField("billed", T.DoubleType()), T.StructField("denial_rate_pct", T.DoubleType())]))),
    ]
)


def read_raw_claims_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, read with the fixed raw schema."""
    return spark.read.schema(RAW_CLAIMS_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    """The appeal-rate seed CSV (rate pinned to double)."""
    return spark.read.schema(SEED_SCHEMA).option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: a published report document (multi-line JSON) with its schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_claim_records_jdbc(spark: SparkSession, url: str, properties: dict, num_partitions: int = 64) -> DataFrame:
    """Claim records from a relational database, read in parallel slices
    of ``record_id``; its smallest and largest value are asked for first, so
    no connection ever pulls the whole table."""
    def reader(table: str):
        return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)

    low, high = reader("(select min(record_id) as lo, max(record_id) as hi from claim_records) as ends").load().first()
    from pyspark.sql import functions as F

    df = (reader("claim_records").option("partitionColumn", "record_id").option("lowerBound", low or 0)
          .option("upperBound", (high or 0) + 1).option("numPartitions", num_partitions).load())
    return df.withColumn("service_date", F.to_date("service_date"))
