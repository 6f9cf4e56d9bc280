"""Domain constants and run parameters.

The values in the FIXED VALUES block must equal the published business rules
(status labels, aging buckets, grade cut-offs, scorecard weights, appeal
success rates). They are stated once here and used everywhere else.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# --- FIXED VALUES (must match the published rules) -------------------------

STATUS_PAID = "Paid"
STATUS_UNDERPAID = "Paid - Underpaid"
STATUS_DENIED = "Denied"
STATUS_PENDING = "Pending"
STATUSES = [STATUS_PAID, STATUS_UNDERPAID, STATUS_DENIED, STATUS_PENDING]
OPEN_AR_STATUSES = [STATUS_PENDING, STATUS_DENIED]

AGING_BUCKETS = ["0-30", "31-60", "61-90", "90+"]
# upper bound (inclusive) of each bucket but the last
AGING_EDGES = [30, 60, 90]

GRADES = ["A", "B", "C", "D"]
# rounded composite score >= 80 A, >= 65 B, >= 50 C, else D
GRADE_EDGES = [(80, "A"), (65, "B"), (50, "C")]

# scorecard weights: denial rate, underpayment rate, avg days to resolve,
# share of open AR older than 90 days (all lower-is-better)
SCORE_WEIGHTS = {
    "denial_rate_pct": 0.35,
    "underpay_rate_pct": 0.25,
    "avg_days_to_resolve": 0.20,
    "pct_ar_90plus": 0.20,
}

CATEGORY_UNDERPAYMENT = "Underpayment"
CATEGORY_APPEAL = "Denial appeal"
CATEGORIES = [CATEGORY_UNDERPAYMENT, CATEGORY_APPEAL]
UNDERPAYMENT_REASON = "Exceeds contracted rate"
UNDERPAYMENT_CONFIDENCE = "High"
ACTION_RESUBMIT = "Resubmit for rate correction"
ACTION_APPEAL = "File appeal"
# appeal success rate >= 0.50 High, >= 0.25 Medium, else Low
CONFIDENCE_EDGES = [(0.50, "High"), (0.25, "Medium")]

# appeal success rate per denial code: (code, label, rate)
APPEAL_SUCCESS_RATES = [
    ("CO-11", "Diagnosis/procedure mismatch", 0.40),
    ("CO-16", "Missing claim information", 0.55),
    ("CO-22", "Coordination of benefits", 0.45),
    ("CO-29", "Filing deadline expired", 0.05),
    ("CO-45", "Exceeds contracted rate", 0.65),
    ("CO-50", "Non-covered service", 0.28),
    ("CO-97", "Bundled into another service", 0.35),
    ("PR-1", "Patient deductible", 0.00),
]
DENIAL_CODES = [c for c, _, _ in APPEAL_SUCCESS_RATES]

# report bands (dashboards)
SPECIALTY_SEVERITY_EDGES = [(19, "high"), (17, "mid")]  # else "low"
PAYER_FLAG_EDGE = 18  # denial rate >= 18 flagged
HEAT_RATE_EDGE = 20  # 90+ rate >= 20
HEAT_SHARE_EDGE = 0.20  # 90+ dollar share >= 0.20
SCORE_BAND_EDGES = [(80, "A"), (65, "B"), (50, "C"), (35, "D")]  # else "F"

# tenant store
ROLES = ["admin", "analyst", "viewer"]
WRITER_ROLES = ["admin", "analyst"]
RECORD_STATUSES = ["paid", "denied", "pending"]
# the only user actions the tenant policy allows; everything else is denied
ALLOWED_ACTIONS = {
    ("organizations", "select"),
    ("app_users", "select"),
    ("claim_records", "select"),
    ("claim_records", "insert"),
    ("report_runs", "select"),
}

# demo app domains
DEMO_INSURERS = ["Acme Health Plan", "Umbrella Insurance Co", "Northwind Mutual", "Globex Benefits"]
DEMO_PROCEDURES = ["90001", "90002", "90003", "90004"]

# --- run parameters ---------------------------------------------------------

# day after the last claim in the driver tables
FIXTURE_AS_OF = dt.date(2001, 8, 2)


@dataclass(frozen=True)
class Params:
    """Run parameters; every date-dependent operator takes ``as_of`` from here
    (never ``current_date()``), so results are reproducible."""

    as_of: dt.date = FIXTURE_AS_OF
    underpayment_tolerance: float = 0.95
    trailing_months: int = 12
    weights: dict = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    top_k: int = 25
