"""Command line for the batch jobs.

    python -m pulse snapshot --sf DIR --variant v8 --out PATH [--cutoffs 3,7,14]
    python -m pulse train    --sf DIR --out PATH [--models rf,gbt] [--folds 5]
    python -m pulse daily    --sf DIR --bundle PATH --out PATH --cutoff 14 --date 2024-01-22
    (each with --csv: the five learner CSV files instead of the driver tables, and
     --module / --presentations: the cohort)
    python -m pulse query    --sf DIR --name snapshot_v8 --out PATH

On a cluster, ``spark-submit -m pulse ...`` uses the launcher's master and configuration;
locally ``--master local[8]`` starts a session with the package defaults.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import config as C


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="pulse")
    ap.add_argument("command", choices=["snapshot", "train", "daily", "query"])
    ap.add_argument("--sf", required=True, help="folder with the driver tables (parquet), or with the "
                    "five learner CSV files when --csv is given")
    ap.add_argument("--csv", action="store_true", help="read studentInfo.csv ... assessments.csv")
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    ap.add_argument("--variant", default="v8")
    ap.add_argument("--cutoffs", default=None)
    ap.add_argument("--models", default="logreg_l1,rf,gbt,mlp")
    ap.add_argument("--folds", type=int, default=5)
    ap.add_argument("--bundle", default=None)
    ap.add_argument("--cutoff", type=int, default=14)
    ap.add_argument("--date", default=None)
    ap.add_argument("--module", default=C.MODULE)
    ap.add_argument("--presentations", default=",".join(C.PRESENTATIONS))
    ap.add_argument("--name", default=None)
    a = ap.parse_args(argv)

    from .session import get_spark
    spark = get_spark(a.master)

    def source():
        from .sources.demo import learner_tables
        from .sources.tables import learner_tables_from_csv
        return learner_tables_from_csv(spark, a.sf) if a.csv else learner_tables(spark, a.sf)

    cohort = {"module": a.module, "presentations": tuple(a.presentations.split(","))}
    if a.command == "snapshot":
        from .operators import early, variants
        cuts = {"cutoffs": [int(x) for x in a.cutoffs.split(",")]} if a.cutoffs else {}
        if a.variant in ("v1", "v2", "v3"):
            df = early.early_snapshot({"v1": early.V1, "v2": early.V2, "v3": early.V3}[a.variant], source(), a.module,
                                      cohort["presentations"][-1])
        elif a.variant == "v10":
            df = variants.snapshot_v10(source(), **cohort)
        else:
            df = getattr(variants, f"snapshot_{a.variant}")(source(), **cohort, **cuts)
        writer = df.write.mode("overwrite")
        (writer.partitionBy("cutoff") if "cutoff" in df.columns else writer).parquet(a.out)
    elif a.command == "train":
        from .plans.train import train_job
        print(json.dumps(train_job(spark, source(), a.out, models=tuple(a.models.split(",")), k=a.folds, **cohort)))
    elif a.command == "daily":
        if not a.date:
            ap.error("daily needs --date")
        from .operators import variants
        from .plans.daily import write_alerts, write_scores
        from .plans.train import load_bundle, score_with_bundle
        fm = load_bundle(spark, a.bundle)
        today = variants.snapshot_v8(source(), cutoffs=(a.cutoff,), **cohort)
        scored = score_with_bundle(fm, today, ["id_student", "cutoff"])
        day = a.date
        write_scores(scored, a.out + "/scores", day)
        # alerts come from the written partition: the scoring plan runs once
        written = (spark.read.parquet(a.out + "/scores").where(F.col("score_date") == F.lit(day).cast("date"))
                   .drop("score_date"))
        write_alerts(written, a.out + "/alerts", day)
        n_alerts = spark.read.parquet(a.out + "/alerts").where(F.col("score_date") == F.lit(day).cast("date")).count()
        print(json.dumps({"alerts_high": n_alerts}))
    elif a.command == "query":
        from . import registry
        registry.queries()[a.name](spark, a.sf).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
