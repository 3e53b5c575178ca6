"""Write the physical plans of the headline queries to PLANS.md (operators only).

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from bench import HEADLINE  # noqa: E402
from tokenloom.plans.registry import QUERIES  # noqa: E402
from tokenloom.session import get_spark  # noqa: E402

KEEP = re.compile(r"(Scan|Exchange|Join|Aggregate|Window|ArrowEval|MapInPandas|FlatMapGroupsInPandas|"
                  r"FlatMapCoGroupsInPandas|Generate|TakeOrderedAndProject|Sort |Filter|Union|Expand|"
                  r"BroadcastExchange|WindowGroupLimit|AQEShuffleRead|Limit)")


def condensed(tree: str) -> str:
    out = []
    for line in tree.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            out.append(line[:160])
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    parts = ["# Physical plans of the headline queries", "",
             f"Generated by `tools/explain_plans.py` at `{sf}` (local[8]); operator lines only, "
             "expression ids removed. Adaptive execution may still convert joins at runtime.", ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf)
        tree = df._jdf.queryExecution().executedPlan().treeString()
        doc = (QUERIES[name].__doc__ or "").strip().splitlines()
        parts += [f"## {name}", "", doc[0] if doc else "", "", "```", condensed(tree), "```", ""]
    open(__file__.rsplit("/tools/", 1)[0] + "/PLANS.md", "w").write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
