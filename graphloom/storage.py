"""The folder that all machines share, and rows kept in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, as a URI; a path without a scheme lies on the default file system.

    Where it is unset, one machine gets a temporary folder, and a cluster an error: machines share no folder of their own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file:///" + whole[6:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there, on whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder: no later stage runs the plan above again, and no lost
    executor takes them along.  With ``spark.cleaner.referenceTracking.cleanCheckpoints`` (see ``session``) Spark removes
    them when nothing refers to them any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
