"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every job in the package. AQE re-plans joins from runtime
# sizes (broadcast only when the measured side is below the threshold), coalesces
# small shuffle partitions and splits skewed ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "pulse",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the package defaults.

    ``master`` is only applied when a new session is created (tests, bench); on a
    cluster the launcher decides.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, else the one set on the context.

    Only a local master (tests) gets a folder of its own when neither is set; on a cluster a
    folder of one machine would lose rows, so that raises.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if path:
        # The context appends a folder of its own to the configured one; set it once.
        if not held.isDefined() or path.rstrip("/").removeprefix("file:") not in held.get():
            context.setCheckpointDir(path)
        return path
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="pulse-ckpt-")
    context.setCheckpointDir(path)
    return path


ROWS_AT_ONCE = 1 << 16  # rows of a partition in steps that read the same rows many times


def spread(written: DataFrame, rows: int | None = None) -> DataFrame:
    """A written or checkpointed frame once more in even partitions, ``parts_for`` its rows. AQE packs
    rows by their bytes, so thousands of narrow ones, dear to work on, end up in one task."""
    ensure_checkpoint_dir(written.sparkSession)
    parts = parts_for(written.sparkSession, written.count() if rows is None else rows)
    return written.repartition(parts).checkpoint()


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows: one a core, more beyond ``ROWS_AT_ONCE`` rows each, fewer for small tables."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-rows // 2048)), -(-rows // ROWS_AT_ONCE))


def scratch_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A table location under the shared checkpoint folder (never a machine-local temp dir
    on a cluster: the folder comes from the session). ``unique`` appends a random suffix so
    two lazily evaluated DataFrames never read a location the other one overwrites."""
    base = ensure_checkpoint_dir(spark)
    suffix = f"-{uuid.uuid4().hex[:12]}" if unique else ""
    return f"{base.rstrip('/')}/pulse/{name}{suffix}"
