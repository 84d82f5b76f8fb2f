import json
import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from pulse.sources.quarantine import HeaderError, learner_tables_from_scans, scan_csv, scan_histories, scan_learner_csvs
from pulse.sources.tables import CSV_SCHEMAS
from pulse.sources.versions import Bundles

VLE = CSV_SCHEMAS["studentVle"]


def folder(name, text):
    d = tempfile.mkdtemp(prefix="pulse-intake-", dir="/tmp")
    with open(os.path.join(d, name), "w") as f:
        f.write(text)
    return os.path.join(d, name)


def test_csv_keeps_bad_lines_apart(spark):
    path = folder("a.csv", "date,note,sum_click,id_site,id_student,code_presentation,code_module\n"
                           "1,x,5,9,100,2024A,BBB\nsoon,x,5,9,101,2024A,BBB\n2,\"a, b\",many,9,102,2024A,BBB\n3,x,,9,103,2024A,BBB\n"
                           "4,x,5,9\n5,x,5,9,105,2024A,BBB,more\n")
    scan = scan_csv(spark, path, VLE)
    assert scan.good.columns == VLE.names
    assert sorted((r.id_student, r.date, r.sum_click) for r in scan.good.collect()) == [(100, 1, 5), (103, 3, None)]
    assert scan.good.select("id_student").count() == 2
    bad = {r.raw.split(",")[0]: r.error for r in scan.bad.collect()}
    assert bad == {"soon": "date is not int", "2": "sum_click is not int", "4": "number of values", "5": "number of values"}
    with pytest.raises(HeaderError, match="id_student"):
        scan_csv(spark, folder("b.csv", "date,sum_click\n1,2\n"), VLE)


def test_json_causes(spark):
    good = {"student_id": "1", "days_since_registration": 14, "vle_activities": [{"date": 1, "sum_click": 2}]}
    lines = [json.dumps(good), json.dumps(good)[:-4], "not json", json.dumps(good | {"days_since_registration": "soon"}),
             json.dumps(good | {"vle_activities": "many"}), json.dumps(good | {"vle_activities": [{"date": 1}]}), "",
             json.dumps({k: v for k, v in good.items() if k != "student_id"}), json.dumps(good | {"vle_activities": None}),
             json.dumps(good | {"vle_activities": [], "extra": 5}), "[1, 2]"]
    scan = scan_histories(spark, folder("h.json", "\n".join(lines)))
    assert sorted(len(r.vle_activities) for r in scan.good.collect()) == [0, 1]
    assert sorted((r.error, r.student_id or "") for r in scan.bad.collect()) == sorted([
        ("record does not parse", "1"), ("record does not parse", ""), ("record does not parse", ""),
        ("days_since_registration is not a whole number", "1"), ("vle_activities is not a list of activities", "1"),
        ("an activity has no date or clicks", "1"), ("student_id is missing", ""), ("vle_activities is missing", "1")])


def test_training_tables_from_scanned_csv(spark):
    from pulse.operators import variants
    from pulse.sources.demo import learner_tables
    d = tempfile.mkdtemp(prefix="pulse-scan-", dir="/tmp")
    t = learner_tables(spark, "/root/testdata/sf0.001")
    frames = {"studentInfo": t.student_info, "studentRegistration": t.student_registration, "studentVle": t.student_vle,
              "studentAssessment": t.student_assessment, "assessments": t.assessments}
    for name, df in frames.items():
        df.select(*CSV_SCHEMAS[name].names).write.option("header", True).csv(os.path.join(d, f"{name}.csv"))
    with open(os.path.join(d, "studentVle.csv", "part-zz.csv"), "w") as f:
        f.write(",".join(VLE.names) + "\nBBB,2024A,1,2,soon,5\n")
    scans = scan_learner_csvs(spark, d)
    assert [s.bad.count() for s in scans.values()].count(1) == 1
    a, b = variants.snapshot_v8(t), variants.snapshot_v8(learner_tables_from_scans(scans))
    assert a.count() > 0 and a.exceptAll(b.select(*a.columns)).count() == 0


def root():
    return tempfile.mkdtemp(prefix="pulse-versions-", dir="/tmp")


def test_versions_and_a_failed_update(spark):
    b = Bundles(spark, root())
    assert b.latest() is None
    first = b.update(lambda c: c | {"threshold": 0.5}, lambda p: spark.range(3).write.parquet(p))
    second = b.update(lambda c: c | {"note": "x"})
    assert b.latest() == second and second["config"] == {"threshold": 0.5, "note": "x"} and second["data"] == first["data"]

    def dies(path):
        spark.range(5).write.parquet(path)
        raise RuntimeError("half way")
    with pytest.raises(RuntimeError, match="half way"):
        b.update(lambda c: c, dies)
    assert b.latest() == second and spark.read.parquet(b.latest()["data"]).count() == 3
    # A writer that died while it wrote its manifest leaves a number that nobody reads.
    open(f"{b.root}/manifests/000000000003.json", "w").close()
    assert b.latest() == second
    assert b.update(lambda c: c | {"n": 1})["version"] == 4 and b.latest()["config"]["n"] == 1


def test_two_updates_at_once(spark):
    path = root()
    Bundles(spark, path).update(lambda c: {"done": []})
    gate, seen = threading.Barrier(2), []

    def work(name):
        first = [True]

        def change(c):
            if first[0]:  # both have read the same version before either creates the next
                first[0] = False
                gate.wait(30)
            return {"done": sorted([*c["done"], name])}
        seen.append(Bundles(spark, path).update(change)["version"])
    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    assert sorted(seen) == [2, 3] and Bundles(spark, path).latest()["config"] == {"done": ["a", "b"]}
