"""Queries over the given tables written out as CSV and JSON text, some lines broken, and read back
through the scans that keep bad lines apart (S1, S2, S3, S9, S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..ml.folds import hash_key
from ..registry import register
from ..session import scratch_path
from ..sources import history as H
from ..sources.quarantine import scan_csv, scan_histories
from ..sources.tables import CSV_SCHEMAS
from . import catalog as Q

BREAK = 17  # one line in so many is broken, by the hash of its key


def _csv_text(spark, sf, name="studentVle"):
    """A learner table as CSV text: every 17th key has a date or a click count that is no number."""
    cols = CSV_SCHEMAS[name].names
    t = Q.T(spark, sf).student_vle.select(*cols)
    h = hash_key(["id_student", "date", "id_site", "sum_click"])
    t = t.withColumn("_h", h).withColumns({c: F.col(c).cast("string") for c in cols})
    t = t.withColumn("sum_click", F.when(F.col("_h") % BREAK == 0, F.concat(F.lit("n/a "), "sum_click")).otherwise(F.col("sum_click")))
    t = t.withColumn("date", F.when(F.col("_h") % BREAK == 1, F.lit("soon")).otherwise(F.col("date")))
    path = scratch_path(spark, "csv-text")
    t.select(*reversed(cols)).write.option("header", True).csv(f"{path}/{name}.csv")
    return f"{path}/{name}.csv"


_VLE_HASH = Q._hash_sql("id_student", "date", "id_site", "sum_click")


@register("csv_scan", Q.W() + f"""
SELECT id_student, CAST(count(*) FILTER (WHERE h % {BREAK} > 1) AS BIGINT) AS n_good,
       CAST(coalesce(sum(sum_click) FILTER (WHERE h % {BREAK} > 1), 0) AS BIGINT) AS clicks,
       CAST(count(*) FILTER (WHERE h % {BREAK} = 0) AS BIGINT) AS n_bad_clicks, CAST(count(*) FILTER (WHERE h % {BREAK} = 1) AS BIGINT) AS n_bad_date
FROM (SELECT *, {_VLE_HASH} AS h FROM student_vle) GROUP BY id_student""")
def csv_scan(spark, sf):
    """Good rows and quarantined lines by learner."""
    scan = scan_csv(spark, _csv_text(spark, sf), CSV_SCHEMAS["studentVle"])
    line = F.split("raw", ",")  # columns are written in reverse: the id is the fourth
    bad = scan.bad.select(line[3].cast("long").alias("id_student"), F.lit(None).cast("int").alias("sum_click"), "error")
    rows = scan.good.select("id_student", "sum_click", F.lit(None).cast("string").alias("error")).unionByName(bad)
    return rows.groupBy("id_student").agg(
        F.count_if(F.col("error").isNull()).alias("n_good"), F.coalesce(F.sum("sum_click"), F.lit(0)).alias("clicks"),
        F.count_if(F.col("error") == "sum_click is not int").alias("n_bad_clicks"), F.count_if(F.col("error") == "date is not int").alias("n_bad_date"))


@register("csv_scan_columns", Q.W() + f"""
SELECT date AS day, CAST(sum(sum_click) AS BIGINT) AS clicks FROM (SELECT *, {_VLE_HASH} AS h FROM student_vle) WHERE h % {BREAK} > 1 GROUP BY date""")
def csv_scan_columns(spark, sf):
    """Two columns of the scan: which lines are bad does not depend on the columns read."""
    scan = scan_csv(spark, _csv_text(spark, sf), CSV_SCHEMAS["studentVle"])
    return scan.good.groupBy(F.col("date").alias("day")).agg(F.sum("sum_click").alias("clicks"))


def _json_text(spark, sf):
    """Histories as JSON lines; by the hash of the id some are cut off, have a word for a number, a
    word for the list, a nested word, or no id."""
    h = H.learner_histories(Q.T(spark, sf)).withColumn("_h", hash_key(["student_id"]) % BREAK)
    text = F.to_json(F.struct("student_id", "days_since_registration", "vle_activities"))
    line = (F.when(F.col("_h") == 0, F.substring(text, F.lit(1), F.length(text) - 3))
            .when(F.col("_h") == 1, F.regexp_replace(text, r'"days_since_registration":-?\d+', '"days_since_registration":"soon"'))
            .when(F.col("_h") == 2, F.regexp_replace(text, r'"vle_activities":\[.*\]', '"vle_activities":"many"'))
            .when(F.col("_h") == 3, F.regexp_replace(text, r'"vle_activities":\[.*\]', '"vle_activities":[{"date":1}]'))
            .when(F.col("_h") == 4, F.regexp_replace(text, r'"student_id":"[^"]*",', "")).otherwise(text))
    path = scratch_path(spark, "json-text")
    h.select(line.alias("value")).write.text(path)
    return path


@register("json_scan", Q.W(O.V11_COHORT) + f""",
d AS (SELECT id_student, dsr, sum(sum_click) AS c FROM vle_mod GROUP BY 1, 2),
k AS (SELECT s.*, {Q._hash_sql('CAST(id_student AS VARCHAR)')} % {BREAK} AS h FROM students s)
SELECT CASE WHEN h <> 4 THEN CAST(k.id_student AS VARCHAR) END AS student_id,
       CASE WHEN h > 4 THEN CAST(coalesce(sum(d.c), 0) AS BIGINT) ELSE -1 END AS total_clicks,
       CASE h WHEN 0 THEN 'record does not parse' WHEN 1 THEN 'days_since_registration is not a whole number'
              WHEN 2 THEN 'vle_activities is not a list of activities' WHEN 3 THEN 'an activity has no date or clicks' WHEN 4 THEN 'student_id is missing' END AS error
FROM k LEFT JOIN d ON d.id_student = k.id_student GROUP BY k.id_student, h""")
def json_scan(spark, sf):
    """Valid records go on, every other line is named with its cause."""
    scan = scan_histories(spark, _json_text(spark, sf))
    clicks = F.aggregate("vle_activities", F.lit(0).cast("bigint"), lambda a, x: a + x["sum_click"].cast("bigint"))
    return (scan.good.select("student_id", clicks.alias("total_clicks"), F.lit(None).cast("string").alias("error"))
            .unionByName(scan.bad.select("student_id", F.lit(-1).cast("bigint").alias("total_clicks"), "error")))


@register("json_scan_scored", Q.W(O.V11_COHORT) + f"""
SELECT CAST(id_student AS VARCHAR) AS student_id, true AS scored FROM students WHERE {Q._hash_sql('CAST(id_student AS VARCHAR)')} % {BREAK} > 4""")
def json_scan_scored(spark, sf):
    """The valid records of a file with broken ones are scored with the saved bundle."""
    from ..functions.clean import clean_features
    from ..operators import variants
    from ..operators.snapshot import FEATURES_15
    from . import train as TR
    fm = Q._bundle(spark, sf)
    rows = scan_histories(spark, _json_text(spark, sf)).good
    x = clean_features(variants.snapshot_v11(rows), FEATURES_15, TR.clean_mode(fm), keep=["student_id"])
    return fm.transform(x, keep=["student_id"]).select("student_id", F.col("proba").between(0, 1).alias("scored"))
