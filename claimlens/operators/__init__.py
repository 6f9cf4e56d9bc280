"""Operators: plain DataFrame -> DataFrame functions (staging, denials, aging,
scorecard, recovery, ranking, demo, tenant, quality, reports)."""
