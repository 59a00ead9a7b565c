"""Cutting lineage in a way that survives lost executors.

Only reliable checkpoints are used.  Their folder is what the cluster names in
``spark.checkpoint.dir``; a folder of our own is set only where that is unset
and the master is local, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder in force; raises on a cluster that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(own := tempfile.mkdtemp(prefix="docweft-checkpoint-"))
    delete_at_end(spark, own)
    return own


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system that holds ``path`` delete it when the driver ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder; what is written there goes when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/docweft-{uuid.uuid4().hex}"
    spark.createDataFrame([], "x int").write.parquet(path + "/made")  # deletion is only noted for what exists
    delete_at_end(spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder: each use reads only the columns it needs."""
    path = scratch(df.sparkSession) + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
