"""What Python workers and intermediate data need from the session."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_package(spark: SparkSession) -> None:
    """Python workers find the package where the driver has it; on a cluster it is installed or sent along."""
    environment = spark.sparkContext.environment
    root, known = str(Path(__file__).resolve().parents[1]), environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Only a local
    master, whose executors are this process, may do without and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def size_of(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of files or folders; what isn't there has none."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = [hadoop.Path(p) for p in paths]
    return sum(fs.getContentSummary(p).getLength() for p, fs in ((p, p.getFileSystem(conf)) for p in at) if fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data, where it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
