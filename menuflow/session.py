"""Session helpers: a local session for tests, and checkpointing in the shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC, as the tests and the bench use it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("menuflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a new temporary one where it is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
        folder = os.environ.setdefault("MENUFLOW_LOCAL_CHECKPOINTS", tempfile.mkdtemp(prefix="menuflow-checkpoint-"))
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, so they survive the loss of an executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` written once and marked for broadcast if it has at most ``max_rows`` rows; beyond that Spark picks the join."""
    from pyspark.sql import functions as F

    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def spread(df: DataFrame, per_core: int = 2 << 20) -> DataFrame:
    """``df`` in one partition per core if it is smaller than ``per_core`` bytes a core by Spark's estimate, for rows that cost much
    each: small files are read by few tasks. Larger input stays as it is read. Give it the table before columns are chosen. Nothing is run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * per_core else df
