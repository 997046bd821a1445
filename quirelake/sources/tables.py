"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder in that of spark.checkpoint.dir, or, where that is unset, in the warehouse; refused where tasks on other machines would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/quirelake-scratch/{spark.sparkContext.applicationId}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it again, so that lost executors cost no earlier step."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
