"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "ashgrid", driver_memory: str = "16g") -> SparkSession:
    """Session used by tests and the bench; a cluster passes its own master and settings.

    The number of shuffle partitions is set only when given, or to 8 for a local master; on a
    cluster Spark's own setting holds (AQE only ever lowers it).  Checkpoint files are removed
    when nothing refers to them any more."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions is None and (master or "").startswith("local"):
        shuffle_partitions = 8
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without one (tests) gets a private temporary folder; on a
    cluster a missing setting is an error, never a silent machine-local fallback.
    """
    sc = spark.sparkContext
    have, named = sc.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return named or have
    if not named:
        if not (sc.master == "local" or (sc.master or "").startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/GCS/NFS) for this cluster")
        named = tempfile.mkdtemp(prefix="ashgrid-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)  # a private folder of this local session
    sc.setCheckpointDir(named)
    return named


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The shuffle files of the step go when its rows are written.  Spark else keeps them until the driver
    happens to collect its garbage, so that a job of many steps holds the shuffles of all of them on disk."""
    spark = df.sparkSession
    checkpoint_root(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # Spark reads the setting when a frame is made
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def small_inputs_to_tasks(spark: SparkSession, size: str = "1m"):
    """While it holds, AQE merges shuffle partitions up to ``size`` only.  For jobs that write far more than they shuffle
    (pairs): sized by the bytes they read they would be a task or two per core, each writing one long file."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": size, "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
