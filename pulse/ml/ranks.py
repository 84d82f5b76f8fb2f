"""Running sums and exact ranks over an order of any length.

Rows are range-partitioned on (group, order), so the pieces are even however the rows are spread
over groups and however crowded the order is; their number follows the row count. What a piece adds
up is one row per (group, piece); these totals are summed along each group and joined back, and the
sums inside a piece are windows over (piece, group). No task sees a whole group, and no cut point
stands in the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

PIECE = 1 << 18  # rows of a piece


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column],
                 totals: Mapping[str, str] | None = None, piece: int = PIECE) -> DataFrame:
    """``df`` with, for every name in ``sums``, the sum of that column over the row itself and all
    rows before it in the order of its group; ``totals`` {name: name in ``sums``} adds whole-group sums.

    The order should be total: rows that tie are summed one after the other in any order. NULL groups
    are groups, NULL values count as 0.
    """
    ensure_checkpoint_dir(df.sparkSession)
    given = df.checkpoint()
    parts = max(1, -(-given.count() // piece))
    values = {n: f"_v_{n}" for n in sums}
    laid = (given.withColumns({v: F.coalesce(sums[n], F.lit(0)) for n, v in values.items()})
            .repartitionByRange(parts, *[F.col(g) for g in group], *order)
            .withColumn("_piece", F.spark_partition_id()).checkpoint())
    held = laid.groupBy(*group, "_piece").agg(*[F.sum(v).alias(v) for v in values.values()])
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    totals = dict(totals or {})
    starts = held.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_piece").alias("_at"),
                         *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_b_{n}") for n, v in values.items()],
                         *[F.sum(values[n]).over(whole).alias(t) for t, n in totals.items()])
    inside = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = laid.withColumns({f"_i_{n}": F.sum(v).over(inside) for n, v in values.items()})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], F.col("_piece") == F.col("_at"))
    return run.join(starts, same).select(*[F.col(f"`{c}`") for c in df.columns],
                                         *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in values], *totals)


def exact_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "_rank", piece: int = PIECE) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of its group."""
    return running_sums(df, group, order, {name: F.lit(1)}, piece=piece).withColumn(name, F.col(name) - 1)
