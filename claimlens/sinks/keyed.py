"""Q1, K6: tables laid out by key, so that key checks move no fact row.

A keyed table is bucketed and sorted by its key: equal keys are in one
bucket. Uniqueness is then an aggregate within each bucket, and a look at
which keys of a batch exist (or a join on the key) moves the batch's rows
only. The number of buckets follows from the table's size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes of a bucket, as Spark estimates the table. A task sorts a bucket's rows, which take ten
#: to fifty times as much as they do in a file
BUCKET_BYTES = 8 << 20


def buckets_for(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of about ``bucket_bytes`` by the plan's size estimate (files on disk
    for a plain scan); a power of two, so that tables of different sizes divide
    each other's buckets and Spark can join them without moving the larger one."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    need = max(1, -(-int(str(size)) // bucket_bytes))
    most = int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))  # Spark's limit; beyond it buckets grow
    return min(1 << (need - 1).bit_length(), 1 << (most.bit_length() - 1))


def write_keyed(df: DataFrame, key: list[str], path: str, buckets: int | None = None) -> DataFrame:
    """df as a parquet table at ``path``, bucketed and sorted by ``key``; returns a reader.

    One shuffle by key, once: a task writes the files of its own buckets."""
    spark = df.sparkSession
    n = buckets or buckets_for(df)
    name = f"keyed_{uuid.uuid4().hex}"
    laid = df.repartition(n, *key).sortWithinPartitions(*key)
    laid.write.bucketBy(n, *key).sortBy(*key).option("path", path).saveAsTable(name)
    return spark.table(name)


def repeated_keys(keyed: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their ``occurrences``. NULL keys
    are ignored. Over a keyed table this is planned without an exchange."""
    not_null = [F.col(k).isNotNull() for k in key]
    rows = keyed
    for c in not_null:
        rows = rows.filter(c)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def known_keys(batch: DataFrame, keyed: DataFrame, key: list[str]) -> DataFrame:
    """batch with ``exists``: whether the keyed table has its key (NULL: no).

    The batch is reduced to its distinct keys, and only these go to the table's
    buckets; the answer meets the batch again in a join that Spark may split
    where many of its rows have one key."""
    asked = batch.select(*key).distinct()
    held = asked.join(keyed.select(*key).hint("merge"), key, "left_semi").withColumn("_held", F.lit(True))
    return batch.join(held, key, "left").withColumn("exists", F.coalesce("_held", F.lit(False))).drop("_held")
