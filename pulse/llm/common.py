"""Helpers shared by the training-data operators.

Every operator first narrows its input to the columns it needs under names of its own
(``documents()``), so extra input columns never clash with the ones it adds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.session import ensure_checkpoint_dir

# One run of white space, and one word, as Java / Python patterns over ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def name(column: str) -> Column:
    """A column by its literal name (dots and spaces allowed)."""
    return F.col("`" + column.replace("`", "``") + "`")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text read as the empty text."""
    return df.select(name(id_col).cast("long").alias("doc_id"),
                     F.coalesce(name(text_col), F.lit("")).alias("text"))


def unused(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have: ``wanted``, lengthened where it is taken."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def one_per_key(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """One row per value of the helper column ``key``, which goes: the smallest by its raw text (null
    first), then by its other columns as JSON. So the choice does not depend on the rows' order."""
    columns = [c for c in rows.columns if c != key]
    others = [name(c) for c in columns if c != text_col]
    order = F.struct(name(text_col).alias("text"), (F.to_json(F.struct(*others)) if others else F.lit("")).alias("rest"))
    # The key holds the id and the text's hash, so only repeated rows meet; they are combined before any shuffle.
    picked = rows.groupBy(name(key)).agg(F.min_by(F.struct(*[name(c) for c in columns]), order).alias("row"))
    return picked.select("row.*").select(*[name(c) for c in columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pulse-llm/{what}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, and
    every later use reads the same rows even after executors were lost."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (Spark removes it with its last reference)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch with a ``text`` (or other) column into slices of about ``most_bytes`` of it
    (a longer single text is a slice of its own), which bounds what a task holds at once."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i in range(n):
        if held and held + sizes[i] > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(sizes[i])
    yield batch.slice(begin, n - begin)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
