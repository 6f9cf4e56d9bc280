"""Written intermediate tables and what operators share on the Spark side."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimlens.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the session's shared folder, read back: the
    lineage ends there, and a lost executor costs no recomputation of it."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """df as a table in the session's shared folder, in buckets by ``key``, read
    back: joins and groups by it move no row of the table. Rows that are
    dealt by the key already (repartition by so many) give a file a bucket."""
    spark: SparkSession = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", scratch_path(spark, table)).saveAsTable(table)
    return spark.table(table)


def written_and_told(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """The written table, and aggregates over it that the same job works out."""
    told = Observation()
    table = written(df.observe(told, *[c.alias(k) for k, c in facts.items()]), name)
    return table, told.get


def id_and_text(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Columns d and t (null text: empty), whatever else df holds."""
    return df.select(F.col(f"`{doc_id}`").alias("d"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts in column t."""
    return docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0


def parts(total: float, each: float) -> int:
    """Number of parts of about ``each`` that ``total`` comes to; grows with the data."""
    return max(1, int(-(-total // each)))


def smallest_hashes(hashes: DataFrame, name: str, total: int, rows: int) -> int:
    """A threshold at or below which lie ``rows`` of the ``total`` 64-bit hashes of column ``name``, and few more.

    Hashes are uniform, so it follows from their range, in whole numbers.
    Where equal keys leave fewer below it, it is raised until enough are."""
    want = rows + 6 * math.isqrt(rows) + 16
    while (cut := (want << 64) // total - (1 << 63)) < (1 << 63) - 1:
        if hashes.where(F.col(name) <= F.lit(cut)).count() >= rows:
            return cut
        want *= 4
    return (1 << 63) - 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges: root is the component's smallest node.

    Alternates large-star and small-star steps until the edges stay as they
    are. Each step keys on nodes and sends one row per edge; the smallest
    neighbour is a partial aggregate, and a hub's rows meet it in a join that
    Spark may split. Each round is one job, whose edges are written to the
    shared folder.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    facts = {"n": F.count(F.lit(1)), "mark": F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))}
    now, before = written_and_told(oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "cc", **facts)
    while before["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = oriented(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, after = written_and_told(oriented(small.unionByName(least.select("u", F.col("m").alias("v")))), "cc", **facts)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
