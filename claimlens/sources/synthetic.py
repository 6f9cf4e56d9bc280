"""Deterministic synthetic claim records (demo mode without a database).

Generated with ``spark.range`` and per-column ``xxhash64(id, seed, column)``
uniforms, so every row depends only on its id: the result is identical for any
partitioning and any re-execution (unlike ``rand(seed)``, whose stream depends
on the partition layout). Same distributions as the demo generator, not the
same bits: service dates in [2026-01-01, +180 d), integer charges in
[120, 600), status paid/denied/pending with p = .74/.18/.08, remit =
charge x U(0.6, 0.9) rounded to cents when paid else 0, four procedure codes
and four insurers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import params as P
from claimlens.functions.fmt import padded_id

START = dt.date(2026, 1, 1)
DAYS = 180
STATUS_P = [("paid", 0.74), ("denied", 0.18), ("pending", 0.08)]


def _uniform(seed: int, column: str) -> Column:
    """U[0,1) from the row id, the seed and the column name."""
    h = F.xxhash64(F.col("id"), F.lit(seed), F.lit(column))
    return (F.pmod(h, F.lit(1 << 52)).cast("double")) / F.lit(float(1 << 52))


def _pick(u: Column, values: list[str]) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(u * len(values)) + 1).cast("int"))


def synthetic_claims(spark: SparkSession, n: int = 600, seed: int = 7, num_partitions: int | None = None) -> DataFrame:
    base = spark.range(0, n, 1, num_partitions)
    u_status = _uniform(seed, "status")
    cum, status = 0.0, None
    for label, p in STATUS_P:
        cum += p
        status = F.when(u_status < cum, label) if status is None else status.when(u_status < cum, label)
    status = status.otherwise(STATUS_P[-1][0])
    charge = (F.lit(120) + F.floor(_uniform(seed, "charge") * 480)).cast("decimal(12,2)")
    factor = (F.lit(0.6) + _uniform(seed, "remit") * 0.3).cast("decimal(10,8)")
    df = base.select(
        "id",
        padded_id("DEMO-", F.col("id")).alias("external_ref"),
        F.date_add(F.lit(START), F.floor(_uniform(seed, "date") * DAYS).cast("int")).alias("service_date"),
        _pick(_uniform(seed, "procedure"), P.DEMO_PROCEDURES).alias("procedure_code"),
        _pick(_uniform(seed, "insurer"), P.DEMO_INSURERS).alias("insurer_name"),
        charge.alias("charge_amount"),
        factor.alias("_f"),
        status.alias("record_status"),
    )
    return df.select(
        "external_ref",
        "service_date",
        "procedure_code",
        "insurer_name",
        "charge_amount",
        F.when(F.col("record_status") == "paid", F.round(F.col("charge_amount") * F.col("_f"), 2))
        .otherwise(F.lit(0))
        .cast("decimal(12,2)")
        .alias("remit_amount"),
        "record_status",
    )
