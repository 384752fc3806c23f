"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which driver and executors share; under its warehouse, if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoint")
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written to a table in the shared folder and read again: its lineage ends here, and it is computed once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
