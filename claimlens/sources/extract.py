"""Landing a raw extract that may have bad lines.

The extract is read once, as text lines parsed by Spark's CSV reader into
the raw columns. Each line is typed, given the reasons why it cannot be
accepted, and written to one table with a partition for accepted lines and one
for rejected ones; nothing is dropped and nothing is read twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: where the CSV reader keeps a line that does not have the columns of the extract
CORRUPT = "_line"


@dataclass(frozen=True)
class Landed:
    """The two sides of a landed extract, as readers on what was written."""

    accepted: DataFrame  # the typed columns
    rejected: DataFrame  # reasons (array), and every column as the text it came as; _line where the line has no such columns


def _typed(name: str, kind: T.DataType) -> Column:
    return F.col(name).try_cast(kind)


def reasons(schema: T.StructType, required: list[str], accepted: dict[str, list[str]] | None = None) -> Column:
    """Why a line is refused, in the order of the columns; empty for a good line.

    ``columns``: another number of fields than the schema has. ``type:c``: a text
    that is no value of the column's type. ``missing:c``: a required value is not
    there. ``value:c``: not one of the accepted ones."""
    broken = F.col(CORRUPT).isNotNull()
    found = [F.when(broken, "columns")]
    for f in schema.fields:
        c = F.col(f.name)
        if not isinstance(f.dataType, T.StringType):
            found.append(F.when(~broken & c.isNotNull() & _typed(f.name, f.dataType).isNull(), f"type:{f.name}"))
        if f.name in required:
            found.append(F.when(~broken & c.isNull(), f"missing:{f.name}"))
        if accepted and f.name in accepted:
            found.append(F.when(~broken & c.isNotNull() & ~c.isin(*accepted[f.name]), f"value:{f.name}"))
    return F.array_compact(F.array(*found))


def land_extract(spark: SparkSession, path: str, table: str, schema: T.StructType, required: list[str],
                 accepted: dict[str, list[str]] | None = None, header: bool = True) -> Landed:
    """Read a CSV extract (each file with a header line, or none) and write it, typed and judged, to
    ``table`` (a new folder) in one job.

    A quoted field may not span lines: files are split, whatever their size."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    lines = (spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    judged = lines.withColumn("reasons", reasons(schema, required, accepted)).withColumn("rejected", F.size("reasons") > 0)
    # the text of refused lines stays as it came; accepted ones have only typed columns
    keep = [F.when(F.col("rejected"), F.col(f.name)).alias(f"raw_{f.name}") for f in schema.fields]
    typed = [F.when(~F.col("rejected"), _typed(f.name, f.dataType)).alias(f.name) for f in schema.fields]
    out = judged.select(*typed, *keep, CORRUPT, "reasons", "rejected")
    out.write.partitionBy("rejected").parquet(table)
    landed = spark.read.schema(out.schema).parquet(table)
    return Landed(landed.filter("NOT rejected").select(*schema.fieldNames()),
                  landed.filter("rejected").select("reasons", *[F.col(f"raw_{c}").alias(c) for c in schema.fieldNames()], CORRUPT))


def reject_summary(rejected: DataFrame) -> DataFrame:
    """reason, lines: how many lines each reason refused (a line may have several)."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two frames with the same columns that are not the same on both
    sides: key, ``side`` (left, right: only there; both) and the columns that differ.

    Every column is compared, null-safe; keys must be unique on either side."""
    rest = [c for c in left.columns if c not in key]
    a = left.select(*key, F.struct(*rest).alias("_a"))
    b = right.select(*key, F.struct(*rest).alias("_b"))
    j = a.join(b, key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in rest]))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return j.select(*key, side.alias("side"), F.when(side == "both", differs).alias("columns")).filter((F.col("side") != "both") | (F.size("columns") > 0))
