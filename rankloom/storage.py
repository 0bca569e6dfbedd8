"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session has none (as in tests) it gets a folder of its own, elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes, in the shared one. It stays for as long as that is kept: results may be read from it later."""
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed now, as a table in the shared folder: what reads it does not compute it again, nor does a lost executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
