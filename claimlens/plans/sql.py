"""SQL entry point: the relations as temp views, so analysts can run SQL text
with ``spark.sql`` (Catalyst plans it exactly like the DataFrame products),
plus the tenant helper as a SQL table function.

Views: claims (warehouse form), payers, expected_rates, stg_claims,
appeal_success_rates, claim_records, app_users, organizations.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from claimlens.operators import recovery
from claimlens.sources import fixture


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Register the views over the session's staged claims (written once,
    see ``catalog.stg``) and the dimension tables of ``sf_dir``."""
    from claimlens import catalog

    stg, warehouse = catalog.stg(spark, sf_dir), catalog.wh(spark, sf_dir)
    views = {
        "claims": warehouse.select(
            "claim_id", "payer_id", "specialty", "claim_date", F.col("status").alias("claim_status"),
            "billed_amount", "paid_amount", "claim_month",  # claim_month: the table's partition key
        ),
        "payers": catalog.payers(spark, sf_dir),
        "expected_rates": fixture.expected_rates(spark, sf_dir),
        "stg_claims": stg,
        "appeal_success_rates": recovery.appeal_rates(spark),
        "claim_records": catalog.records(spark, sf_dir),
        "app_users": catalog.users(spark, sf_dir),
        "organizations": fixture.organizations(spark, sf_dir),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    # RL1 as a SQL table function: the org ids of one user
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION user_org_ids(uid BIGINT) "
        "RETURNS TABLE (org_id INT) "
        "RETURN SELECT DISTINCT org_id FROM app_users WHERE user_id = uid"
    )
    return list(views)
