"""Plan facts of every registered query: exchanges, joins and other plan nodes to look at.

    python tests/plan_audit.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import re
import sys

from compare import session

MARKS = {
    "single": "Exchange SinglePartition",
    "nested_loop": "BroadcastNestedLoopJoin",
    "cartesian": "CartesianProduct",
    "row_udf": "BatchEvalPython",
    "arrow_udf": "ArrowEvalPython",
    "broadcast": "BroadcastExchange",
    "hash": "Exchange hashpartitioning",
    "range": "Exchange rangepartitioning",
    "smj": "SortMergeJoin",
}


def main(argv: list[str]) -> None:
    from tarn.checks import QUERIES

    sf = "/root/testdata/sf0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf, argv = argv[i + 1], argv[:i] + argv[i + 2:]
    spark = session()
    for name, fn in QUERIES.items():
        if argv and name not in argv:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        found = {k: len(re.findall(re.escape(v), plan)) for k, v in MARKS.items()}
        print(name, {k: n for k, n in found.items() if n}, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
