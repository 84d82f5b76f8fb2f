"""Maps the driver's tables onto the five learner tables (see FIXTURES.md section 3).

Everything is a lazy projection/aggregate of ``events`` and ``customer``, so the work
grows with those tables and Catalyst prunes the columns each query needs.

Fixed values of the mapping: day 0 is 2024-01-08; module 'AAA' for even ids else 'BBB';
presentation '2024A' when floor(id/2) is even else '2024B'; unregister day
8 + (7 id) mod 14 when id mod 3 = 0; id_site = event_id mod 5; id_assessment =
event_id mod 7; submission date NULL when event_id mod 13 = 0; score NULL when
event_id mod 11 = 0; assessment module 'AAA' for even assessment ids else 'BBB'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

DAY_ZERO = "2024-01-08"


def day_of(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(DAY_ZERO).cast("date"))


def module_of(uid: Column) -> Column:
    return F.when(F.pmod(uid, F.lit(2)) == 0, F.lit("AAA")).otherwise(F.lit("BBB"))


def presentation_of(uid: Column) -> Column:
    return F.when(F.pmod(F.floor(uid / 2), F.lit(2)) == 0, F.lit("2024A")).otherwise(F.lit("2024B"))


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


@dataclass(frozen=True)
class LearnerTables:
    student_info: DataFrame
    student_registration: DataFrame
    student_vle: DataFrame
    student_assessment: DataFrame
    assessments: DataFrame


# Replication factor for scaling runs: copy r of the log gets learner ids shifted by
# r * ID_SHIFT (and event ids by r * EVENT_SHIFT), so every copy is a disjoint set of learners
# with the same click behaviour. 1 means the table as given.
ID_SHIFT = 10_000_000
EVENT_SHIFT = 10_000_000_000


def events(spark: SparkSession, sf_dir: str, columns, replicate: int = 1) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", list(columns))
    if replicate <= 1:
        return ev
    r = F.explode(F.sequence(F.lit(0), F.lit(replicate - 1))).alias("_rep")
    ev = ev.select("*", r)
    out = []
    for c in columns:
        if c == "user_id":
            out.append((F.col("user_id") + F.col("_rep") * ID_SHIFT).alias("user_id"))
        elif c == "event_id":
            out.append((F.col("event_id") + F.col("_rep") * EVENT_SHIFT).alias("event_id"))
        else:
            out.append(F.col(c))
    return ev.select(*out)


def _events(spark: SparkSession, sf_dir: str, kind: str, replicate: int = 1) -> DataFrame:
    ev = events(spark, sf_dir, ["event_id", "ts", "user_id", "event_type", "props"], replicate)
    return ev.where(F.col("event_type") == kind)


def student_vle(spark: SparkSession, sf_dir: str, replicate: int = 1) -> DataFrame:
    uid = F.col("user_id")
    return _events(spark, sf_dir, "click", replicate).select(
        uid.alias("id_student"),
        module_of(uid).alias("code_module"),
        presentation_of(uid).alias("code_presentation"),
        F.pmod(F.col("event_id"), F.lit(5)).alias("id_site"),
        day_of(F.col("ts")).alias("date"),
        k_of(F.col("props")).alias("sum_click"),
    )


def student_assessment(spark: SparkSession, sf_dir: str, replicate: int = 1) -> DataFrame:
    eid = F.col("event_id")
    return _events(spark, sf_dir, "purchase", replicate).select(
        F.pmod(eid, F.lit(7)).alias("id_assessment"),
        F.col("user_id").alias("id_student"),
        F.when(F.pmod(eid, F.lit(13)) == 0, F.lit(None)).otherwise(day_of(F.col("ts"))).cast("int")
        .alias("date_submitted"),
        F.lit(0).alias("is_banked"),
        F.when(F.pmod(eid, F.lit(11)) == 0, F.lit(None)).otherwise(k_of(F.col("props"))).cast("double")
        .alias("score"),
        eid.alias("id_submission"),
    )


def student_registration(spark: SparkSession, sf_dir: str, replicate: int = 1, repeats: bool = False) -> DataFrame:
    """``repeats``: every fifth learner registers for the other presentation as well: three days
    later (every tenth: on the same day), unregistering on day 20 if and only if the first
    registration stays."""
    ev = events(spark, sf_dir, ["ts", "user_id", "event_type"], replicate)
    uid = F.col("user_id")
    per_user = ev.groupBy(uid).agg(
        F.min(F.when(F.col("event_type") == "signup", day_of(F.col("ts")))).alias("date_registration"))
    first = per_user.select(
        uid.alias("id_student"),
        module_of(uid).alias("code_module"),
        presentation_of(uid).alias("code_presentation"),
        F.col("date_registration").cast("int").alias("date_registration"),
        F.when(F.pmod(uid, F.lit(3)) == 0, F.lit(8) + F.pmod(uid * 7, F.lit(14)))
        .cast("int").alias("date_unregistration"),
    )
    if not repeats:
        return first
    sid, cols = F.col("id_student"), ["code_presentation", "date_registration", "date_unregistration"]
    second = F.struct(
        F.when(F.col("code_presentation") == "2024A", F.lit("2024B")).otherwise(F.lit("2024A")).alias("code_presentation"),
        (F.col("date_registration") + F.when(F.pmod(sid, F.lit(10)) == 0, F.lit(0)).otherwise(F.lit(3))).cast("int").alias("date_registration"),
        F.when(F.col("date_unregistration").isNull(), F.lit(20)).cast("int").alias("date_unregistration"))
    rows = F.when(F.pmod(sid, F.lit(5)) == 0, F.array(F.struct(*cols), second)).otherwise(F.array(F.struct(*cols)))
    return first.select("id_student", "code_module", F.explode(rows).alias("r")).select("id_student", "code_module", "r.*")


def student_info(spark: SparkSession, sf_dir: str, registration: DataFrame | None = None) -> DataFrame:
    reg = registration if registration is not None else student_registration(spark, sf_dir)
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    uid = F.col("id_student")
    demo = (cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
            .join(region, F.col("n_regionkey") == region.r_regionkey, "left"))
    # One row per customer key, stated as an aggregate: the optimizer then knows the key is
    # unique and drops the whole demographic join from plans that use no demographic column.
    demo = demo.groupBy("c_custkey").agg(*[F.max(c).alias(c) for c in ("n_name", "r_name", "c_acctbal",
                                                                         "c_mktsegment")])
    joined = reg.join(demo, reg.id_student == demo.c_custkey, "left")
    return joined.select(
        F.col("code_module"), F.col("code_presentation"), uid,
        F.when(F.pmod(uid, F.lit(2)) == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        F.col("n_name").alias("region"),
        F.col("r_name").alias("highest_education"),
        F.when(F.col("c_acctbal") < 0, F.lit(None))
        .when(F.col("c_acctbal") < 5000, F.lit("0-50%")).otherwise(F.lit("50-100%")).alias("imd_band"),
        F.col("c_mktsegment").alias("age_band"),
        F.pmod(F.floor(uid / 4), F.lit(3)).cast("int").alias("num_of_prev_attempts"),
        (F.lit(30) + F.lit(30) * F.pmod(uid, F.lit(5))).cast("int").alias("studied_credits"),
        F.when(F.pmod(uid, F.lit(10)) == 0, F.lit("Y")).otherwise(F.lit("N")).alias("disability"),
        F.when(F.col("date_unregistration").isNotNull(), F.lit("Withdrawn"))
        .otherwise(F.lit("Pass")).alias("final_result"),
    )


def assessments(spark: SparkSession, sf_dir: str, replicate: int = 1) -> DataFrame:
    """Assessment dimension: every assessment id seen in submissions, in both presentations
    (a Generate over the two presentation labels, no join)."""
    ids = student_assessment(spark, sf_dir, replicate).select("id_assessment").distinct()
    return ids.select("id_assessment", F.explode(F.array(F.lit("2024A"), F.lit("2024B"))).alias("code_presentation")).select(
        F.when(F.pmod(F.col("id_assessment"), F.lit(2)) == 0, F.lit("AAA")).otherwise(F.lit("BBB"))
        .alias("code_module"),
        F.col("code_presentation"), F.col("id_assessment"))


def learner_tables(spark: SparkSession, sf_dir: str, replicate: int = 1, repeats: bool = False) -> LearnerTables:
    reg = student_registration(spark, sf_dir, replicate, repeats)
    return LearnerTables(
        student_info=student_info(spark, sf_dir, reg),
        student_registration=reg,
        student_vle=student_vle(spark, sf_dir, replicate),
        student_assessment=student_assessment(spark, sf_dir, replicate),
        assessments=assessments(spark, sf_dir, replicate),
    )
