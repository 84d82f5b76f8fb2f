"""CSV scan with declared schemas (S1/S2/X1), nested-history JSON round trip (S3)."""

import os
import tempfile

from pyspark.sql import functions as F

from pulse.sources.history import learner_histories, read_histories
from pulse.sources.demo import learner_tables
from pulse.sources.tables import read_learner_csv

SF = "/root/testdata/sf0.001"


def test_csv_scan_declared_schema_and_coercion(spark):
    d = tempfile.mkdtemp(prefix="pulse-csv-", dir="/tmp")
    t = learner_tables(spark, SF)
    cols = ["code_module", "code_presentation", "id_student", "id_site", "date", "sum_click"]
    t.student_vle.select(*cols).coalesce(1).write.option("header", True).csv(os.path.join(d, "studentVle.csv"))
    with open(os.path.join(d, "bad.csv"), "w") as fh:
        fh.write("code_module,code_presentation,id_student,id_site,date,sum_click\nBBB,2024A,1,2,x7,??\n")
    os.rename(os.path.join(d, "bad.csv"), os.path.join(d, "studentVle.csv", "part-bad.csv"))
    vle = read_learner_csv(spark, d, "studentVle")
    assert dict(vle.dtypes)["sum_click"] == "int" and dict(vle.dtypes)["id_student"] == "bigint"
    bad = vle.where(F.col("date").isNull()).collect()
    assert len(bad) == 1 and bad[0]["sum_click"] is None and bad[0]["id_student"] == 1
    assert vle.count() == t.student_vle.count() + 1
    pruned = read_learner_csv(spark, d, "studentVle", ["id_student", "date"])
    assert pruned.columns == ["id_student", "date"]


def test_nested_history_json_round_trip(spark):
    d = tempfile.mkdtemp(prefix="pulse-hist-", dir="/tmp")
    h = learner_histories(learner_tables(spark, SF))
    h.write.json(os.path.join(d, "h"))
    back = read_histories(spark, os.path.join(d, "h"))
    assert back.schema["vle_activities"].dataType.elementType.names == ["date", "sum_click"]
    a = sorted((r["student_id"], r["days_since_registration"], len(r["vle_activities"])) for r in h.collect())
    b = sorted((r["student_id"], r["days_since_registration"], len(r["vle_activities"])) for r in back.collect())
    assert a == b


def test_learner_tables_from_csv_give_the_same_panel(spark):
    from pulse.operators import variants
    from pulse.sources.tables import CSV_SCHEMAS, learner_tables_from_csv
    d = tempfile.mkdtemp(prefix="pulse-csvall-", dir="/tmp")
    t = learner_tables(spark, SF)
    frames = {"studentInfo": t.student_info, "studentRegistration": t.student_registration,
              "studentVle": t.student_vle, "studentAssessment": t.student_assessment,
              "assessments": t.assessments}
    for name, df in frames.items():
        df.select(*CSV_SCHEMAS[name].names).coalesce(1).write.option("header", True).csv(os.path.join(d, f"{name}.csv"))
    c = learner_tables_from_csv(spark, d)
    a = variants.snapshot_v8(t)
    b = variants.snapshot_v8(c).select(*a.columns)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    a4 = variants.snapshot_v4(t)
    b4 = variants.snapshot_v4(c).select(*a4.columns)
    assert a4.exceptAll(b4).count() == 0
