"""Global row numbering of a large frame without a single-partition exchange.

``row_number() over (order by ...)`` with no partition key moves every row
into one task. Instead:

1. sort globally on the full sort key: a range exchange (Spark samples the
   key to choose balanced boundaries; AQE may coalesce small ranges) plus a
   sort within each partition. Because the key ends with a unique
   tie-breaker, no single value can overload a partition, even one held by
   a third of all rows. The sorted frame is ``checkpoint()``-ed to the shared
   checkpoint folder, which fixes which row sits in which partition and in
   what order: both uses below read the same files, and a lost executor
   re-reads them instead of re-sampling new boundaries;
2. each row's position inside its partition comes from
   ``monotonically_increasing_id()`` (partition index in the upper bits,
   position in the lower 33 bits);
3. count rows per partition (one row per partition), turn the counts into
   running offsets, and broadcast that table (its size is the partition
   count, fixed once the checkpoint is written);
4. rank = offset of the partition + position + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import ensure_checkpoint_dir

_POS_BITS = 33


def distributed_row_number(
    df: DataFrame,
    order: list[Column],
    name: str = "row_number",
) -> DataFrame:
    """Append ``name`` = 1-based position of each row in ``order``.

    ``order`` must be a total order (end with a unique column); otherwise
    ties are numbered in an unspecified order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # a global sort: range partitions whose count AQE fits to the data size
    ranged = df.orderBy(*order).checkpoint(eager=True)
    ranged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", _POS_BITS))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    pos = F.col("_mid") - F.shiftleft("_pid", _POS_BITS)
    out = ranged.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + pos + F.lit(1))
    return out.drop("_mid", "_pid", "_off")
