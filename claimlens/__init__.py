"""claimlens: claims analytics (denials, AR aging, payer scorecard, recovery)
expressed as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame(s) -> DataFrame``; nothing is
collected to the driver except bounded, report-sized results.

Entry points:
- ``claimlens.catalog.REGISTRY``: every product (Spark query + DuckDB oracle);
- ``claimlens.plans.build.build_all``: stage -> marts -> tests -> documents;
- ``claimlens.plans.sql.register_views``: temp views for SQL text;
- ``python -m claimlens build|product``: the command line.
"""

from claimlens.params import Params

__all__ = ["Params"]
