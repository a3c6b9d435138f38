"""Reduction of updates that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyloom.functions.reducers import Reducer, reducer
from pyspark.sql import functions as F


def reduce_stream(updates: DataFrame, by: str | Reducer) -> DataFrame:
    """key, value of a stream (key, value); the state is one partial value a key."""
    return updates.where("key is not null and value is not null").groupBy("key").agg(reducer(by)(F.col("value")).alias("value"))


def parquet_updates(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(reduced: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Takes all that is there, ends, and leaves the reduced table in memory under `name`; a restart with the same
    checkpoint goes on where the last one ended."""
    query = reduced.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
