"""Scaling run: the V8 panel (13 cutoffs) and the batched raw-history features on the event log
replicated 1x, 10x, 100x with shifted learner ids (same plan, nothing collected). Writes
SCALING.md."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulse.operators import variants  # noqa: E402
from pulse.session import get_spark  # noqa: E402
from pulse.sources.demo import learner_tables  # noqa: E402
from pulse.sources.history import learner_histories  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=32, extra={"spark.ui.showConsoleProgress": "false"})
    rows = ["# SCALING", "", f"`tools/scaling.py {sf}` on local[8]; best of two warm runs, `noop` sink.", "",
            "| replication | events | query | output rows | seconds | rows/s |", "|---|---|---|---|---|---|"]
    n_events = spark.read.parquet(os.path.join(sf, "events.parquet")).count()
    queries = {
        "snapshot_v8": lambda t: variants.snapshot_v8(t),
        "snapshot_v11": lambda t: variants.snapshot_v11(learner_histories(t)),
    }
    for name, q in queries.items():   # warm-up
        q(learner_tables(spark, sf)).write.format("noop").mode("overwrite").save()
    for rep in (1, 10, 100):
        for name, q in queries.items():
            best = float("inf")
            for _ in range(2):
                t0 = time.perf_counter()
                q(learner_tables(spark, sf, replicate=rep)).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - t0)
            n = q(learner_tables(spark, sf, replicate=rep)).count()
            rows.append(f"| {rep}x | {n_events * rep:,} | {name} | {n:,} | {best:.2f} | {n / best:,.0f} |")
            print(rows[-1], flush=True)
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "SCALING.md"), "w").write(
        "\n".join(rows) + "\n")


if __name__ == "__main__":
    main()
