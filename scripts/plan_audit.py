"""Audit the physical plans of all registered queries for patterns that do not scale:
Cartesian products, nested-loop joins, and exchanges into a single partition."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsmill.plans import load_all  # noqa: E402
from opsmill.session import build_session  # noqa: E402

PATTERNS = {"cartesian": r"CartesianProduct", "nested_loop": r"BroadcastNestedLoopJoin",
            "single_partition": r"Exchange SinglePartition", "python_udf": r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[4]", 8)
    reg = load_all()
    for name, fn in reg.QUERIES.items():
        try:
            plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: plan error {str(e)[:120]}")
            continue
        hits = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        hits = {k: v for k, v in hits.items() if v}
        if hits:
            print(f"{name}: {hits}")
    spark.stop()


if __name__ == "__main__":
    main()
