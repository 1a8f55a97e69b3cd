"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``; where that is unset, in a folder of this machine, if Spark runs on no other."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read back: computed once, and no executor's to lose."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
