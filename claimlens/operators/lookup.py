"""Scalar lookups with the cardinality rule of a scalar subquery.

``(SELECT value FROM table WHERE table.key = facts.key)`` gives NULL where no
row matches and fails where more than one does. A join would double the fact
row instead. Here the table is reduced to one row per key with its number of
rows (a partial aggregate per task, no extra job), joined to the facts, and
the value can only be read through a guard that fails above one. Keys that
no fact uses may repeat, as they may in the subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AmbiguousLookup(ValueError):
    """Names the columns of a lookup in the message of the failing task."""


def _per_key(table: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    return table.groupBy(*on).agg(F.count(F.lit(1)).alias("_matches"), *[F.first(v).alias(v) for v in values])


def _guarded(value: str, on: list[str], what: str) -> Column:
    told = F.concat(F.lit(f"{what}: more than one row for ({', '.join(on)}) = ("), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]), F.lit(")"))
    return F.when(F.col("_matches") > 1, F.raise_error(told)).otherwise(F.col(value))


def scalar_lookup(facts: DataFrame, table: DataFrame, on: list[str], values: list[str], what: str = "lookup", required: bool = False) -> DataFrame:
    """``facts`` with ``values`` of the one row of ``table`` that has the same
    ``on`` columns; NULL where there is none (such facts go if ``required``,
    as in a comparison with NULL). A fact that finds two or more rows, equal
    or not, fails the query when one of the values is read.

    NULL keys match nothing. Columns of ``values`` may not exist in ``facts``."""
    clash = [v for v in values if v in facts.columns]
    if clash:
        raise AmbiguousLookup(f"{what}: facts have columns {clash} already")
    found = facts.join(_per_key(table.select(*on, *values), on, values), on, "inner" if required else "left")
    return found.select(*facts.columns, *[_guarded(v, on, what).alias(v) for v in values])


def lookup_conflicts(facts: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Which lookups :func:`scalar_lookup` would refuse: each key that facts use
    and ``table`` has more than once, with ``matches`` and ``facts`` (rows)."""
    several = table.groupBy(*on).agg(F.count(F.lit(1)).alias("matches")).filter("matches > 1")
    used = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("facts"))
    return used.join(several, on).select(*on, "matches", "facts")
