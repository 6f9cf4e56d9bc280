import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from claimlens.session import build_session

    s = build_session("local[*]", app_name="claimlens-tests", shuffle_partitions=8)
    yield s
    s.stop()


def make_stg(spark, rows):
    """Staged claims from compact hand-made rows:
    (claim_id, claim_date, payer, specialty, billed, paid, status, code, days, gap)."""
    from decimal import Decimal

    from claimlens.operators.staging import stg_claims

    schema = (
        "claim_id string, claim_date date, payer string, specialty string, billed_amount decimal(12,2), "
        "paid_amount decimal(12,2), status string, denial_code string, denial_reason string, "
        "days_to_resolve double, underpayment_gap decimal(12,2), payer_id int"
    )
    fixed = []
    for r in rows:
        cid, d, payer, spec, billed, paid, status, code, days, gap = r
        fixed.append((
            cid, d if isinstance(d, dt.date) else dt.date.fromisoformat(d), payer, spec,
            None if billed is None else Decimal(str(billed)), None if paid is None else Decimal(str(paid)),
            status, code, None, None if days is None else float(days),
            None if gap is None else Decimal(str(gap)), sum(map(ord, payer)) % 100 if payer else None,
        ))
    raw = spark.createDataFrame(fixed, schema)
    return stg_claims(raw, keep=["payer_id"])
