"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _top(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; where that is unset, below a local one if the driver is all there is."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"{tempfile.gettempdir()}/clausework-shared"
    return f"{top.rstrip('/')}/clausework-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written out and read again, so that its lineage ends at files that outlive an executor."""
    path = f"{_top(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove all that the application has written here; what was read from it can't be run again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_top(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
