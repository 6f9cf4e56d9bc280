"""Q1-Q8: data-quality and consistency checks as Spark jobs.

Each check returns its failing rows (``*_failures``) or a per-check summary
(``check``, ``column``, ``failures``). Checks on one table are fused into a
single aggregate so a table is scanned once for all of its column checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_failures(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q1: key values that occur more than once (NULL keys are ignored, as
    a unique constraint ignores them). Partial aggregation keeps a hot key
    cheap: each map task emits one row per distinct key it saw."""
    not_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (
        df.filter(not_null)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )


def summary(table: str, df: DataFrame, not_null=(), accepted=None, non_negative=()) -> DataFrame:
    """Q2 + Q3 + Q4 in one pass: counts of NULLs, values outside the
    accepted set, and negative values, one output row per (check, column)."""
    accepted = accepted or {}
    aggs, labels = [], []
    for c in not_null:
        aggs.append(F.count_if(F.col(c).isNull()))
        labels.append(("not_null", c))
    for c, values in accepted.items():
        aggs.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)))
        labels.append(("accepted_values", c))
    for c in non_negative:
        aggs.append(F.count_if(F.col(c) < 0))
        labels.append(("non_negative", c))
    row = df.agg(*[a.alias(f"_q{i}") for i, a in enumerate(aggs)])
    stack = ", ".join(f"'{chk}', '{col}', `_q{i}`" for i, (chk, col) in enumerate(labels))
    out = row.selectExpr(f"stack({len(labels)}, {stack}) as (check, column_name, failures)")
    return out.select(
        F.lit(table).alias("table_name"), "check", "column_name", F.col("failures").cast("bigint").alias("failures")
    )


def foreign_key_failures(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Q5: child rows whose key has no parent row (NULL keys are allowed,
    as in SQL). The parent is usually a dimension; the join strategy is left
    to Catalyst's size statistics."""
    pk = parent_key or key
    p = parent.select(F.col(pk).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(p, key, "left_anti")


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Q6: fill write defaults (column -> Column/literal) where NULL or
    missing."""
    out = df
    for c, v in defaults.items():
        val = v if isinstance(v, F.Column) else F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), val) if c in df.columns else val)
    return out


# --- Q7 / Q8 consistency against a published document ------------------------------

SCORE_TOLERANCES = {
    "denial_rate_pct": ("denial_rate", 0.05),
    "underpay_rate_pct": ("underpay_rate", 0.05),
    "avg_days_to_resolve": ("avg_days_to_resolve", 0.05),
    "pct_ar_90plus": ("pct_ar_90plus", 0.05),
    "composite_score": ("composite_score", 0.05),
    "total_billed": ("total_billed", 1.0),
    "total_paid": ("total_paid", 1.0),
}


def scorecard_diff(actual: DataFrame, published: DataFrame) -> DataFrame:
    """Q7: compare the scorecard mart with the published scorecard rows
    (``payer, rank, grade, composite_score, denial_rate, ...``).

    Full outer join on payer and null-safe comparisons: a payer missing on
    either side, or a NULL on one side only, is reported as a difference.
    Returns one row per payer with ``ok``."""
    p = published.select(
        "payer",
        F.col("rank").cast("bigint").alias("published_rank"),
        F.col("grade").alias("published_grade"),
        *[F.col(pub).cast("double").alias(f"published_{pub}") for _, (pub, _) in SCORE_TOLERANCES.items()],
    )
    j = actual.join(p, "payer", "full_outer")
    bad = [
        ~F.col("payer_rank").eqNullSafe(F.col("published_rank")),
        ~F.col("grade").eqNullSafe(F.col("published_grade")),
    ]
    for mine, (pub, tol) in SCORE_TOLERANCES.items():
        a, b = F.col(mine), F.col(f"published_{pub}")
        bad.append(F.coalesce(F.abs(a - b) > F.lit(tol), ~a.eqNullSafe(b)))
    ok = ~reduce(lambda x, y: x | y, bad)
    return j.select(
        "payer",
        F.col("composite_score").alias("actual_score"),
        F.col("published_composite_score").alias("published_score"),
        F.col("grade").alias("actual_grade"),
        "published_grade",
        F.col("payer_rank").alias("actual_rank"),
        "published_rank",
        ok.alias("ok"),
    )


RECOVERY_MEASURES = [
    ("total_recovery_potential", 1.0),
    ("underpayment_recovery", 1.0),
    ("appeal_recovery", 1.0),
    ("high_confidence_recovery", 1.0),
    ("n_opportunities", 0.0),
]


def recovery_diff(actual: DataFrame, published: DataFrame) -> DataFrame:
    """Q8: one row per summary measure (actual, published, ok). Both inputs
    are one-row frames; they are combined with ``stack`` into long form and
    joined on the measure name (no cross join)."""

    def long(df: DataFrame, value: str) -> DataFrame:
        pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m, _ in RECOVERY_MEASURES)
        return df.selectExpr(f"stack({len(RECOVERY_MEASURES)}, {pairs}) as (measure, {value})")

    tol = F.create_map(*[x for m, t in RECOVERY_MEASURES for x in (F.lit(m), F.lit(t))])
    j = long(actual, "actual").join(long(published, "published"), "measure", "full_outer")
    ok = F.coalesce(F.abs(F.col("actual") - F.col("published")) <= tol[F.col("measure")], F.lit(False))
    return j.select("measure", "actual", "published", ok.alias("ok"))


def profile(model: str, df: DataFrame, unique: str | None = None, not_null=(), accepted=None) -> DataFrame:
    """All schema tests of one table in ONE pass: (model, check, column_name,
    failures) rows for unique (on one key), not_null and accepted_values.

    With a unique key the rows are grouped by it once (partial aggregation per
    map task) and the null / accepted counts ride along in the same groups."""
    accepted = accepted or {}
    flags = [(("not_null", c), F.col(c).isNull()) for c in not_null]
    flags += [(("accepted_values", c), F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in accepted.items()]
    labels = [lab for lab, _ in flags]
    if unique:
        g = df.groupBy(unique).agg(
            F.count(F.lit(1)).alias("_n"), *[F.count_if(cond).alias(f"_f{i}") for i, (_, cond) in enumerate(flags)]
        )
        aggs = [F.count_if(F.col(unique).isNotNull() & (F.col("_n") > 1)).alias("_u")]
        aggs += [F.sum(f"_f{i}").alias(f"_f{i}") for i in range(len(flags))]
        row = g.agg(*aggs)
        labels = [("unique", unique)] + labels
        cols = ["_u"] + [f"_f{i}" for i in range(len(flags))]
    else:
        row = df.agg(*[F.count_if(cond).alias(f"_f{i}") for i, (_, cond) in enumerate(flags)])
        cols = [f"_f{i}" for i in range(len(flags))]
    stack = ", ".join(f"'{chk}', '{col}', CAST(coalesce(`{c}`, 0) AS BIGINT)" for (chk, col), c in zip(labels, cols))
    out = row.selectExpr(f"stack({len(labels)}, {stack}) as (check, column_name, failures)")
    return out.select(F.lit(model).alias("model"), "check", "column_name", "failures")
