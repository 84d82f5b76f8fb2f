"""Exact de-duplication (built-in functions only).

Rows are grouped by the 128-bit content hash *and* the bytes of the normalised text: the hash
deals the groups out, the bytes inside the grouping key exclude collisions. The grouping is
pre-aggregated before the shuffle, so a text that a third of all rows share is sent once per
input task, not once per row.

A document then finds its group by the hash alone, which needs no text in the shuffle; only
hashes under which two different texts were seen (collisions) are resolved by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, name, one_per_key, stage_table, unused


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 content_hash: Callable[[Column], Column] = F.md5,
                 normalise: Callable[[Column], Column] = normalised) -> DataFrame:
    """One row per document with its group of equal texts.

    Columns: doc_id, keep_id (smallest doc_id of the group), group_size (rows of the group,
    repeats included), kept, text_sha256 (of the normalised text).

    Null text counts as empty; all empty texts are one group. Rows that repeat both id and
    text are one document (one row out, all counted in group_size). A null id never wins over
    another id; a group of null ids only keeps the null id. Two texts under one id are two
    documents. An empty table gives no rows. Other input columns are ignored.

    ``content_hash`` may be any deterministic hash: collisions cost time, never correctness.
    """
    d = documents(docs, id_col, text_col).select("doc_id", normalise(F.col("text")).alias("norm"))
    d = d.withColumn("h", content_hash(F.col("norm")))

    groups = stage_table(
        d.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")), "text-groups")
    collided = stage_table(groups.groupBy("h").count().filter("count > 1").select("h"), "collided")
    clean = collided.isEmpty()

    members = d.select("doc_id", "h").distinct()
    found = members.join(groups if clean else groups.join(collided, "h", "left_anti"), "h")
    columns = ["doc_id", "keep_id", "group_size",
               F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if clean:
        return found.select(*columns)
    # Two texts share a hash: their members are grouped and found by the bytes themselves.
    clash = d.join(collided, "h", "left_semi")
    clash_groups = clash.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"),
                                                  F.count(F.lit(1)).alias("group_size"))
    by_text = (clash.distinct().join(clash_groups, ["h", "norm"])
               .withColumn("text_sha256", F.sha2("norm", 256)))
    return found.select(*columns).unionByName(by_text.select(*columns))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns. Of rows that repeat the id
    and the normalised text the one with the smallest raw text (null first) stays, of equal ones
    the one whose other columns come first as JSON. Null and empty texts are one group; an empty
    table gives no rows; columns of any name stay as they are."""
    def key(sha, doc_id):  # one text key for both sides, so that the join's shuffle is the only one
        return F.concat_ws(":", sha, doc_id.cast("string"))

    key_col = unused(docs, "keep_key")
    keep = exact_groups(docs, id_col, text_col).filter("kept").select(key(F.col("text_sha256"), F.col("doc_id")).alias(key_col))
    sha = F.sha2(normalised(F.coalesce(name(text_col), F.lit(""))), 256)
    kept = docs.withColumn(key_col, key(sha, name(id_col).cast("long"))).join(keep, key_col, "left_semi")
    return one_per_key(kept.select(*[name(c) for c in docs.columns], key_col), key_col, text_col)
