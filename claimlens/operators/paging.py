"""K7: an ordered listing that is read page by page.

The rows are sorted once into ranges of the order (date, id): each range is a
folder, and a manifest says which places and keys it holds. A page after a
cursor looks at the manifest, then reads the one or two folders it needs; no
page sorts the table or skips rows it has to read first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: rows of a range
RANGE_ROWS = 1 << 20


@dataclass(frozen=True)
class Listing:
    """Rows laid out by (date, id), and a row per range: its first place, number
    of rows, and first and last key."""

    rows: DataFrame
    manifest: DataFrame
    order: tuple[str, str]

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def placed(self) -> DataFrame:
        """All rows with their 1-based ``place`` in the whole order: numbered
        within their range, from where the range begins."""
        inside = F.row_number().over(Window.partitionBy("range").orderBy(*_order(self.order)))
        return self.rows.join(self.manifest.select("range", "first_place"), "range").withColumn("place", F.col("first_place") + inside - 1).drop("first_place", "range")

    def page(self, size: int, after: tuple | None = None) -> DataFrame:
        """The first ``size`` rows after the cursor, a (date, id) pair (None:
        from the beginning), in order. A row with a NULL date comes first."""
        a, b = self.order
        ranges = self.manifest
        if after is not None:
            ranges = ranges.filter(_after(F.col("last")[a], F.col("last")[b], after))
        # the first range may end just after the cursor, so the page is looked for in as many more as hold ``size`` rows
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        held = F.coalesce(F.sum("n").over(before) - F.first("n").over(before), F.lit(0))
        some = ranges.withColumn("_held", held).filter(F.col("_held") < size).select("range").collect()
        rows = self.rows.filter(F.col("range").isin([r["range"] for r in some]))
        if after is not None:
            rows = rows.filter(_after(F.col(a), F.col(b), after))
        return rows.orderBy(*_order(self.order)).limit(size).drop("range")

    def pages(self, size: int) -> Iterator[list]:
        """Page after page, each asked for with the cursor of the one before."""
        after = None
        while got := self.page(size, after).collect():  # one page
            yield got
            after = (got[-1][self.order[0]], got[-1][self.order[1]])


def _order(order: tuple[str, str]) -> list:
    return [F.asc_nulls_first(c) for c in order]


def _after(date, key, cursor: tuple):
    """(date, key) comes after the cursor; NULL dates come first."""
    d, k = cursor
    if d is None:
        return date.isNotNull() | (date.isNull() & (key > F.lit(k)))
    return (date > F.lit(d)) | ((date == F.lit(d)) & (key > F.lit(k)))


def lay_out(df: DataFrame, path: str, date: str = "service_date", key: str = "external_ref", range_rows: int = RANGE_ROWS) -> Listing:
    """Sort df into ranges of about ``range_rows`` rows at ``path``. ``key`` must
    be unique and not null; with the date it is the order. A date that a third
    of all rows have is split like any other run of keys."""
    spark = df.sparkSession
    n = max(1, -(-df.count() // range_rows))
    ranged = df.repartitionByRange(n, *_order((date, key))).sortWithinPartitions(*_order((date, key)))
    ranged.withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{path}/rows")
    rows = spark.read.schema(df.withColumn("range", F.lit(0)).schema).parquet(f"{path}/rows")
    ends = F.struct(date, key)
    told = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min(ends).alias("first"), F.max(ends).alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    told.withColumn("first_place", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).coalesce(1).write.parquet(f"{path}/manifest")
    return Listing(rows, spark.read.parquet(f"{path}/manifest"), (date, key))
