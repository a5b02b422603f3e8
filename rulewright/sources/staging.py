"""Tables between the steps of a query, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, if all of Spark runs in this one process; other
    masters raise a ValueError, since their executors would write to disks of their own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rulewright-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def run_dir(spark: SparkSession) -> str:
    """This application's own folder under the shared one; every table between steps lies in it."""
    return f"{shared_dir(spark)}/rulewright-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: its plan is computed once, and a lost executor costs no more than a reread."""
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables between steps; results that still read them can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
