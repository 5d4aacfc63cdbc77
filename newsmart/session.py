"""Session defaults shared by every job.

Nothing here starts a cluster: a job passes its own session in, and these
helpers only pin what results depend on (UTC, ANSI off for tolerant casts) and
find the shared folder used to cut lineage.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import newsmart

RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
}

ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Shuffle files go when the action that wrote them ends: what is read again has been checkpointed.
DISK_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leave sizing to the cluster."""
    cloudpickle.register_pickle_by_value(newsmart)  # workers need no copy of the package on their path
    for key, value in {**RESULT_CONF, **ADAPTIVE_CONF, **DISK_CONF}.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(max(8, sc.defaultParallelism)))  # the default suits a cluster
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a scratch folder only in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps iterative plans short.

    Spark's own frame of a checkpoint keeps what was estimated of the plan that made it. Every join multiplies the sizes of its
    sides, so in a loop of joins these numbers get twice as many digits with each pass, until the driver does nothing but
    multiply them. The rows are therefore taken into a frame without estimates; adaptive execution measures them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    rows = done.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done.schema(), False), spark)


def local_session(cpus: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("newsmart")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RESULT_CONF, **ADAPTIVE_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one streaming run, under the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
