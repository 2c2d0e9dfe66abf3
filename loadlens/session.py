"""Session settings and the shared work folder for written intermediate tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of this package relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(
    app: str = "loadlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session for jobs, tests and the bench; a cluster may pass its own instead."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(RUNTIME_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="loadlens-")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names that shared folder. Only where it is unset on a local
    master (tests, a laptop) is a temporary folder taken instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or \
                spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return os.path.join(root.rstrip("/"), f"{purpose}-{uuid.uuid4().hex}")


def write_and_read(df: DataFrame, purpose: str, release: bool = False) -> DataFrame:
    """Cut lineage through a written table, so a lost executor costs a re-read only.

    With ``release`` the driver collects its garbage afterwards: Spark deletes the shuffle files
    of a finished plan only when the plan is collected, which may be after the job.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(spark: SparkSession) -> None:
    """Name a shared checkpoint folder to the context where the cluster has named none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoints"))
