"""Cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """The folder for this session, from ``spark.checkpoint.dir``. Where that is unset: a temporary one on one machine, an
    error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that the whole cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed now, written to the shared folder and read from there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_table(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written now as a Parquet table in the shared folder, and read from there."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
