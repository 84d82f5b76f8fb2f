"""Parquet/CSV/JSON scans with declared schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

# Declared schemas of the five learner tables when they arrive as CSV files.
STUDENT_INFO = T.StructType([
    T.StructField("code_module", T.StringType()),
    T.StructField("code_presentation", T.StringType()),
    T.StructField("id_student", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("highest_education", T.StringType()),
    T.StructField("imd_band", T.StringType()),
    T.StructField("age_band", T.StringType()),
    T.StructField("num_of_prev_attempts", T.IntegerType()),
    T.StructField("studied_credits", T.IntegerType()),
    T.StructField("disability", T.StringType()),
    T.StructField("final_result", T.StringType()),
])
STUDENT_REGISTRATION = T.StructType([
    T.StructField("code_module", T.StringType()),
    T.StructField("code_presentation", T.StringType()),
    T.StructField("id_student", T.LongType()),
    T.StructField("date_registration", T.IntegerType()),
    T.StructField("date_unregistration", T.IntegerType()),
])
STUDENT_VLE = T.StructType([
    T.StructField("code_module", T.StringType()),
    T.StructField("code_presentation", T.StringType()),
    T.StructField("id_student", T.LongType()),
    T.StructField("id_site", T.LongType()),
    T.StructField("date", T.IntegerType()),
    T.StructField("sum_click", T.IntegerType()),
])
STUDENT_ASSESSMENT = T.StructType([
    T.StructField("id_assessment", T.LongType()),
    T.StructField("id_student", T.LongType()),
    T.StructField("date_submitted", T.IntegerType()),
    T.StructField("is_banked", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])
ASSESSMENTS = T.StructType([
    T.StructField("code_module", T.StringType()),
    T.StructField("code_presentation", T.StringType()),
    T.StructField("id_assessment", T.LongType()),
])
CSV_SCHEMAS = {
    "studentInfo": STUDENT_INFO,
    "studentRegistration": STUDENT_REGISTRATION,
    "studentVle": STUDENT_VLE,
    "studentAssessment": STUDENT_ASSESSMENT,
    "assessments": ASSESSMENTS,
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """One driver table; ``columns`` prunes the parquet read schema."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_learner_csv(spark: SparkSession, data_dir: str, name: str, columns=None) -> DataFrame:
    """CSV scan of one learner table with its declared schema (no inference).

    Values that do not parse become NULL (PERMISSIVE mode), the counterpart of a
    coercing numeric read.
    """
    df = (spark.read.schema(CSV_SCHEMAS[name]).option("header", True)
          .option("mode", "PERMISSIVE").csv(os.path.join(data_dir, f"{name}.csv")))
    return df.select(*columns) if columns else df


def load_learner_csvs(spark: SparkSession, data_dir: str) -> dict:
    """All five learner tables from CSV files."""
    return {name: read_learner_csv(spark, data_dir, name) for name in CSV_SCHEMAS}


def learner_tables_from_csv(spark: SparkSession, data_dir: str):
    """The five learner tables in their original CSV layout -> ``LearnerTables``.

    Columns are read with the declared schemas (unparsable values become NULL). Submissions
    carry no id of their own in that layout; ``id_submission`` is a hash of the row, used only
    as the last tie-breaker when ordering submissions of the same day and assessment.
    """
    from pyspark.sql import functions as F

    from .demo import LearnerTables
    t = load_learner_csvs(spark, data_dir)
    sa = t["studentAssessment"]
    sa = sa.withColumn("id_submission", F.xxhash64(*[F.col(c) for c in sa.columns]))
    return LearnerTables(student_info=t["studentInfo"], student_registration=t["studentRegistration"],
                         student_vle=t["studentVle"], student_assessment=sa, assessments=t["assessments"])
