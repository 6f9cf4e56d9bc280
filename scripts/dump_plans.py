"""Write PLANS.md: the physical plan tree (``explain("formatted")``, tree part
only) of every registered product, plus a one-line summary of its joins and
exchanges. Run: python scripts/dump_plans.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimlens import catalog  # noqa: E402
from claimlens.plans.inspect import physical_plan  # noqa: E402
from claimlens.session import build_session  # noqa: E402

OPS = (r"BroadcastHashJoin \w+|SortMergeJoin \w+|ShuffledHashJoin \w+|BroadcastNestedLoopJoin|CartesianProduct|"
       r"TakeOrderedAndProject|Window|Exchange|BroadcastExchange|HashAggregate|Scan parquet|Scan ExistingRDD|LocalTableScan")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    out = [
        "# Physical plans", "",
        f"Initial (pre-AQE) physical plans at `{sf}`, from `scripts/dump_plans.py`. ",
        "Staged claims are read from the month-partitioned table the session writes once "
        "(`catalog.stg`), so most plans start at that scan.", "",
    ]
    for name, prod in catalog.REGISTRY.items():
        plan = physical_plan(prod.fn(spark, sf))
        tree = plan.split("\n\n")[0].replace("== Physical Plan ==\n", "")
        counts = Counter(m.group(0) for m in re.finditer(OPS, tree))
        single = "SinglePartition" in plan
        out += [f"## {name} ({prod.ids})", "",
                "operators: " + ", ".join(f"{k} x{v}" for k, v in sorted(counts.items()))
                + (" — has a SinglePartition exchange (report-sized input)" if single else ""), "",
                "```", tree.rstrip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print("wrote", path)


if __name__ == "__main__":
    main()
