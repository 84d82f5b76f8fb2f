"""Write PLANS.md: the static physical plans (AQE and broadcast off, i.e. the worst case a
large cluster would start from) of the headline queries, with their exchanges listed."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulse import registry  # noqa: E402
from pulse.session import get_spark  # noqa: E402

HEADLINE = ["snapshot_v8", "snapshot_v4", "snapshot_v11", "assessment_snapshot", "roc_auc",
            "strat_group_folds", "daily_rollup_stream"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[4]", shuffle_partitions=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    q = registry.queries()
    out = ["# PLANS", "",
           "Static physical plans (AQE off, automatic broadcast off) of the headline queries, generated by",
           "`tools/plans.py`. With AQE on, the small dimension sides (nation, region, the registration",
           "table at demo sizes) become broadcast joins after their measured size is known; the plans",
           "below are the shape a cluster starts from when every side is large.", ""]
    for name in HEADLINE:
        df = q[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"#\d+L?", "", plan)
        plan = re.sub(r"\[plan_id=\d+\]", "", plan)
        plan = re.sub(r"Location: [^,]*, ", "", plan)
        ex = [line.strip() for line in plan.splitlines() if "Exchange" in line]
        out += [f"## {name}", "", f"Exchanges: {len(ex)}", ""]
        out += [f"- `{e[:160]}`" for e in ex]
        out += ["", "```", *[line[:220] for line in plan.splitlines()], "```", ""]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(out) + "\n")


if __name__ == "__main__":
    main()
