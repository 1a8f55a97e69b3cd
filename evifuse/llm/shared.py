"""What the operators share: table reading, the cluster's shared folder, fixed patterns."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.sources.ship import ship  # noqa: F401  the operators' queries take it from here

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs on no other machine (tests), a folder of this machine is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    It cuts the lineage and survives lost executors, as the files belong to no executor. The folder is the
    cluster's scratch space; its retention rule removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)  # zstd, for whole texts, keeps native buffers of every small task until a collection
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text") -> DataFrame:
    """The column with null as the empty text."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
