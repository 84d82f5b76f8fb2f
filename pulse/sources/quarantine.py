"""Scans that keep apart what they cannot read.

Nothing is dropped and nothing turns silently into NULL: a scan gives the good rows and, in a table
of their own, the bad ones as they stood in the file with the cause. What was parsed is written
once, so both tables come from the same pass, whichever columns are read later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .history import RAW_HISTORY
from .tables import CSV_SCHEMAS

RAW = "_raw_line"


@dataclass(frozen=True)
class Scan:
    good: DataFrame
    bad: DataFrame


class HeaderError(ValueError):
    """A file whose header does not name the declared columns."""


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> Scan:
    """CSV files with a declared schema.

    Columns are found by the header's names, in any order; columns that are not declared are read
    and left out, a missing one raises ``HeaderError``. A line with a value that does not parse, or
    with too many or too few values, is bad: ``bad`` has the line as ``raw`` and its ``error``, the
    first column in declared order that has text but no value, or 'number of values'. Empty values
    are NULL and good. An empty folder gives two empty tables.
    """
    header = csv_header(spark, path)
    lost = [f.name for f in schema if f.name not in header]
    if header and lost:
        raise HeaderError(f"missing columns: {', '.join(lost)}")
    own = {f.name: f for f in schema}
    read = T.StructType([own.get(c, T.StructField(c, T.StringType())) for c in (header or own)] + [T.StructField(RAW, T.StringType())])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW, "columnPruning": False, "enforceSchema": True}
    out = scratch_path(spark, "csv-scan")
    spark.read.options(**options).schema(read).csv(path).write.parquet(out)
    parsed = spark.read.schema(read).parquet(out)
    # The raw line once more as text columns tells which value was at fault.
    texts = ", ".join(f"`{c}` string" for c in (header or own))
    held = F.from_csv(F.col(RAW), texts, {"mode": "PERMISSIVE"})
    bad = parsed.where(F.col(RAW).isNotNull()).withColumn("_t", held)
    values = F.size(F.split(F.col(RAW), ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    error = F.when(values != len(header or own), "number of values")
    for f in schema:
        text = F.col("_t").getField(f.name)
        error = error.when(F.col(f"`{f.name}`").isNull() & text.isNotNull() & (text != ""), f"{f.name} is not {f.dataType.simpleString()}")
    return Scan(parsed.where(F.col(RAW).isNull()).select(*[F.col(f"`{f.name}`") for f in schema]),
                bad.select(F.col(RAW).alias("raw"), error.otherwise("line does not parse").alias("error")))


def scan_learner_csvs(spark: SparkSession, data_dir: str) -> dict[str, Scan]:
    return {name: scan_csv(spark, f"{data_dir.rstrip('/')}/{name}.csv", schema) for name, schema in CSV_SCHEMAS.items()}


def learner_tables_from_scans(scans: dict[str, Scan]):
    """``LearnerTables`` of the good rows, with a submission id as ``learner_tables_from_csv`` gives."""
    from .demo import LearnerTables
    sa = scans["studentAssessment"].good
    sa = sa.withColumn("id_submission", F.xxhash64(*[F.col(c) for c in sa.columns]))
    return LearnerTables(student_info=scans["studentInfo"].good, student_registration=scans["studentRegistration"].good,
                         student_vle=scans["studentVle"].good, student_assessment=sa, assessments=scans["assessments"].good)


def _field_error(text: Column, value: Column, name: str, what: str) -> tuple[Column, str]:
    return text.isNotNull() & value.isNull(), f"{name} is not {what}"


def scan_histories(spark: SparkSession, path: str) -> Scan:
    """Nested histories as JSON lines (S3) with the records that cannot be used kept apart.

    ``bad`` has the line as ``raw``, the ``student_id`` as far as it can be found in the line, and the
    ``error``: the record does not parse; a field has another type; a required field is missing;
    an activity lacks its date or clicks. ``good`` has the declared nested schema. Empty lines are
    no records.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    row = F.from_json("value", RAW_HISTORY, {"mode": "PERMISSIVE"})
    whole = F.from_json("value", T.StructType([*RAW_HISTORY.fields, T.StructField("_corrupt", T.StringType())]),
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = scratch_path(spark, "json-scan")
    (lines.withColumns({"p": parts, "r": row, "c": whole.getField("_corrupt")}).write.parquet(out))
    t = spark.read.parquet(out)
    p, r = F.col("p"), F.col("r")
    unparsed = p.isNull() | (F.size(p) <= 0) | ~F.col("value").rlike(r"^\s*\{.*\}\s*$")
    activities = r["vle_activities"]
    causes = [
        (unparsed, "record does not parse"),
        _field_error(p["days_since_registration"], r["days_since_registration"], "days_since_registration", "a whole number"),
        _field_error(p["vle_activities"], activities, "vle_activities", "a list of activities"),
        (F.exists(activities, lambda a: a.isNull()), "an activity is not a record"),
        (F.col("c").isNotNull(), "a nested value has another type"),
        (r["student_id"].isNull(), "student_id is missing"),
        (r["days_since_registration"].isNull(), "days_since_registration is missing"),
        (activities.isNull(), "vle_activities is missing"),
        (F.exists(activities, lambda a: a["date"].isNull() | a["sum_click"].isNull()), "an activity has no date or clicks"),
    ]
    error = F.when(F.coalesce(causes[0][0], F.lit(True)), causes[0][1])
    for cond, text in causes[1:]:
        error = error.when(F.coalesce(cond, F.lit(False)), text)
    t = t.withColumn("error", error)
    found = F.coalesce(r["student_id"], F.regexp_extract("value", r'"student_id"\s*:\s*"([^"]*)"', 1))
    return Scan(t.where("error IS NULL").select("r.*"),
                t.where("error IS NOT NULL").select(F.when(found != "", found).alias("student_id"), "error", F.col("value").alias("raw")))
