"""Cutting lineage in loops: written to the folder all machines share, never kept on one executor alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path of this application in `spark.checkpoint.dir`. Where that is not set, a local session takes a folder of
    its machine; a cluster is refused, since its executors would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = "/tmp/checkpoints"
    return f"{where}/keyloom-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Written and read back: the plan before it is forgotten, and its size is known to the plans that follow (a
    checkpoint keeps estimates, which joins multiply in every round of a loop)."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
