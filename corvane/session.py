"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def get_session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; conf overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a temporary one only on a local master, as in tests.

    Elsewhere a missing setting is an error: executors would write to their own disks and lose what they wrote.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corvane-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint folder; it is deleted when the driver's JVM ends."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from its files, so a lost executor costs no recomputation.

    A table rather than checkpoint(), as Spark plans with the true sizes of its files: what checkpoint() carries on are
    estimates, and over the rounds of an iteration the products of joins grow beyond what the driver can hold.
    """
    folder = shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
