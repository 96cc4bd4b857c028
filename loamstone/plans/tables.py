"""Reading input tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the session names one.

    Only a session on a single machine gets a temporary folder; on a cluster without that setting there is none, which is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loamstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    The lineage ends there, so losing an executor re-reads files instead of re-running the plan;
    Parquet keeps it smaller than a checkpointed RDD, and later scans prune its columns. The files are deleted when the
    driver's JVM ends; ``clear`` does so before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes the tables that ``cut`` has written; DataFrames made from them can't be read any more."""
    while _CUTS:
        at = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small table in one file would keep one core busy.

    Large tables have more partitions than cores and stay as they are, and so does what comes out of a shuffle, whose
    partitions couldn't be counted without running it.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
