"""In-memory rows -> DataFrame with the declared feature schema.

Used for hand-made cases (tests, what-if rows); registered queries never run on these alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .history import FEATURE_ROW_15


def feature_rows(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """Rows given as dicts; absent features become NULL (validated / filled downstream)."""
    names = FEATURE_ROW_15.names
    data = [tuple(r.get(n) if n == "student_id" else (None if r.get(n) is None else float(r.get(n)))
                  for n in names) for r in rows]
    return spark.createDataFrame(data, FEATURE_ROW_15)
