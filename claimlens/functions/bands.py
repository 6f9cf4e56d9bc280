"""Banding rules (aging buckets, grades, confidence tiers, report bands) as
Column expressions: ``when`` chains that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _chain_ge(x: Column, edges, otherwise) -> Column:
    expr = None
    for edge, label in edges:
        cond = x >= F.lit(edge)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(otherwise)


def aging_bucket(days) -> Column:
    """<=30, <=60, <=90, else (including NULL days) '90+'."""
    d = _c(days)
    e1, e2, e3 = P.AGING_EDGES
    b1, b2, b3, b4 = P.AGING_BUCKETS
    return F.when(d <= e1, b1).when(d <= e2, b2).when(d <= e3, b3).otherwise(b4)


def bucket_order(bucket) -> Column:
    b = _c(bucket)
    b1, b2, b3, _ = P.AGING_BUCKETS
    return F.when(b == b1, 1).when(b == b2, 2).when(b == b3, 3).otherwise(4)


def grade(score) -> Column:
    """Grade of an already rounded composite score; NULL score -> 'D'."""
    return _chain_ge(_c(score), P.GRADE_EDGES, "D")


def confidence(rate) -> Column:
    return _chain_ge(_c(rate), P.CONFIDENCE_EDGES, "Low")


def specialty_severity(rate_pct) -> Column:
    return _chain_ge(_c(rate_pct), P.SPECIALTY_SEVERITY_EDGES, "low")


def payer_flag(rate_pct) -> Column:
    return _c(rate_pct) >= F.lit(P.PAYER_FLAG_EDGE)


def heat_by_rate(rate_pct) -> Column:
    return _c(rate_pct) >= F.lit(P.HEAT_RATE_EDGE)


def heat_by_share(share) -> Column:
    return _c(share) >= F.lit(P.HEAT_SHARE_EDGE)


def score_band(score) -> Column:
    return _chain_ge(_c(score), P.SCORE_BAND_EDGES, "F")
