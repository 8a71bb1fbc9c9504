"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a local folder on a local master; on others an error,
    since each executor would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-tallgrass-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "tables") -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again."""
    path = folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
