"""Incremental upkeep of the day-collapsed click table with Structured Streaming.

The reference refreshes its daily alert list from a scheduler; the expensive input of that job
is the (learner, day) click table. New event files are folded into it by a stream: every
micro-batch is collapsed to (learner, day) totals and written under its batch number, replacing
what a failed attempt of the same batch left, so each event counts exactly once across restarts
and lost executors. Totals of a day simply add up over batches: a click may arrive any time
later, in any file order, and open days are there as far as they have come. ``compact`` folds
the batches into one when there are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.demo import day_of, k_of

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
TOTALS = "id_student bigint, day int, clicks bigint"


def click_stream(spark: SparkSession, events_dir: str, file_glob: str = "events*.parquet") -> DataFrame:
    """Streaming (learner, day, k); the day is the log's own calendar day (no time zone)."""
    src = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", file_glob)
           .option("maxFilesPerTrigger", 64).parquet(events_dir))
    return src.where(F.col("event_type") == "click").select(
        F.col("user_id").alias("id_student"), day_of(F.col("ts")).alias("day"), k_of(F.col("props")).alias("k"))


def run_daily_rollup(spark: SparkSession, events_dir: str, out_dir: str, checkpoint_dir: str,
                     file_glob: str = "events*.parquet") -> None:
    """Fold every file available now into the table, stop."""
    def fold(batch: DataFrame, number: int) -> None:
        totals = batch.groupBy("id_student", "day").agg(F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("clicks"))
        totals.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    q = (click_stream(spark, events_dir, file_glob).writeStream.foreachBatch(fold)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def read_daily_rollup(spark: SparkSession, out_dir: str) -> DataFrame:
    """The learner-day table: one row per (learner, day) over all batches."""
    parts = spark.read.schema(TOTALS).parquet(out_dir)
    return parts.groupBy("id_student", "day").agg(F.sum("clicks").cast("bigint").alias("clicks"))


def compact(spark: SparkSession, out_dir: str, to_dir: str) -> None:
    """The table so far as one batch of another folder."""
    read_daily_rollup(spark, out_dir).write.mode("overwrite").parquet(f"{to_dir}/batch=0")
