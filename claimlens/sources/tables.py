"""Parquet table scans of the input warehouse (one folder per scale factor).

Readers pass the expected schema of the columns they use, so Spark skips
footer-based schema inference and the scan's ``ReadSchema`` holds exactly
those columns; filters written later push into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# column -> type of the warehouse tables (only the columns read here)
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def customer(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def nation(spark, sf_dir):
    return table(spark, sf_dir, "nation")


def region(spark, sf_dir):
    return table(spark, sf_dir, "region")
