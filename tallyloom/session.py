"""Session set-up and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side with at most this many rows is broadcast; beyond it the join stays a shuffle join.
BROADCAST_ROWS = 200_000

# Up to so many rows one task can sort or hold a whole group, even if all rows are in it.
ONE_TASK_ROWS = 200_000

# Up to so many rows the built-in percentile holds a group's values in one task (under 100 bytes each).
PERCENTILE_ROWS = 2_000_000

# Size of a scan split.
SCAN_SPLIT_BYTES = 128 * 1024 * 1024

# A small input is dealt out to tasks of at least this size; one beyond the ceiling never is, on any cluster.
SPREAD_TASK_BYTES = 16 * 1024
SPREAD_CEILING_BYTES = 1 << 30


def build_session(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators count on: AQE with skew splitting, UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only a master within this process may fall back to a temporary folder; elsewhere the setting is required.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors and are computed only once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, later scans read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Size bound Catalyst derives from the input files, without running a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_one_task(df: DataFrame, rows: int | None = None) -> bool:
    """Counts rows, of which it stops reading at the limit; file sizes say little about rows behind a compression."""
    limit = ONE_TASK_ROWS if rows is None else rows
    if limit < 0:
        return False
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def settled(df: DataFrame) -> DataFrame:
    """The rows, stored first if they are more than scanned, filtered and projected, so that reading twice costs no second parse."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return cut_lineage(df) if any(node in plan for node in ("Generate ", "Join ", "Aggregate ", "Window ")) else df


def spread_small_scan(df: DataFrame, key: str) -> DataFrame:
    """Deal out an input that is too small to give every core a scan split of its own, by a unique key.

    A large input has many splits already and is returned untouched; above 1 GB nothing is shuffled, whatever the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = plan_bytes(df)
    if size >= min(cores * SCAN_SPLIT_BYTES, SPREAD_CEILING_BYTES):
        return df
    return df.repartition(max(1, min(cores, size // SPREAD_TASK_BYTES)), key)
