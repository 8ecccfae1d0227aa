"""Documents that arrive in a folder, read as they come; each is independent of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def arriving_lines(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """doc_id, pos, line and its kind, of the Parquet files that arrive at a path."""
    rows = spark.readStream.schema(schema).parquet(path)
    lines = rows.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return lines.withColumn("kind", T.kind(F.col("line")))
