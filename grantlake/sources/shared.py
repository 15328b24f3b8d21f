"""The folder that all machines of a cluster share: checkpoints, and tables that a query writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # since Spark 4.1; earlier ones take no notice of it


def _checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in spark.checkpoint.dir, which all machines share.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or "/tmp/checkpoints/grantlake")
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it outlives the executors that wrote it.

    The shuffle files behind it go when it is written: nothing reads them again, and otherwise they would lie on the
    executors' disks until the driver collects its garbage. Spark takes that setting when a plan is made.
    """
    spark = df.sparkSession
    _checkpoints(spark)
    before = spark.conf.get(FILES_GO, "false")
    spark.conf.set(FILES_GO, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(FILES_GO, before)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder for a table that a query writes and reads back.

    Where the reader comes after the function has returned, the folder stays, as checkpoints do, until
    the cluster clears its checkpoint folder.
    """
    return f"{_checkpoints(spark)}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``shared_folder`` that nothing reads any more."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)
