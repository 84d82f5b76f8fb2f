import tempfile

from pulse.operators.cohort import collapse_daily
from pulse.sources.demo import learner_tables
from pulse.streaming.daily_rollup import compact, read_daily_rollup, run_daily_rollup

SF = "/root/testdata/sf0.001"


def _folder(kind):
    return tempfile.mkdtemp(prefix=f"pulse-{kind}-", dir="/tmp")


def _same(a, b):
    cols = ["id_student", "day", "clicks"]
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_stream_rollup_equals_batch_collapse(spark):
    d = _folder("roll")
    want = collapse_daily(learner_tables(spark, SF).student_vle)
    run_daily_rollup(spark, SF, d + "/out", d + "/ck")
    _same(read_daily_rollup(spark, d + "/out"), want)
    run_daily_rollup(spark, SF, d + "/out", d + "/ck")  # nothing new: nothing added
    _same(read_daily_rollup(spark, d + "/out"), want)
    compact(spark, d + "/out", d + "/one")
    _same(read_daily_rollup(spark, d + "/one"), want)


def test_late_files_add_to_days_already_written(spark):
    src, d = _folder("events"), _folder("roll")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.where("event_id % 2 = 1").orderBy("ts", ascending=False).coalesce(1).write.mode("overwrite").parquet(src + "/a")
    import glob
    import shutil
    shutil.copy(glob.glob(src + "/a/part*.parquet")[0], src + "/events1.parquet")
    run_daily_rollup(spark, src, d + "/out", d + "/ck")
    events.where("event_id % 2 = 0").coalesce(1).write.mode("overwrite").parquet(src + "/b")
    shutil.copy(glob.glob(src + "/b/part*.parquet")[0], src + "/events2.parquet")
    run_daily_rollup(spark, src, d + "/out", d + "/ck")
    _same(read_daily_rollup(spark, d + "/out"), collapse_daily(learner_tables(spark, SF).student_vle))


def test_days_do_not_depend_on_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        d = _folder("roll-tz")
        run_daily_rollup(spark, SF, d + "/out", d + "/ck")
        _same(read_daily_rollup(spark, d + "/out"), collapse_daily(learner_tables(spark, SF).student_vle))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
