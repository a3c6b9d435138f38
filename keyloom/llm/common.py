"""Small helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words; every operator's word is a maximal run of other characters.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: F.length(w) > 0)


def fresh(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that further input columns cannot clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def row_key(docs: DataFrame) -> Column:
    """128 bits of the id and the text; rows that are equal in both share it."""
    own = [docs["doc_id"].isNull(), docs["doc_id"], F.coalesce(docs["text"], F.lit(""))]
    return F.struct(F.xxhash64(*own).alias("x"), F.xxhash64(F.lit(1), *own).alias("y"))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one all machines share, `spark.checkpoint.dir`. Where that is not set, a
    local session takes a folder of its machine; a cluster is refused, since its executors would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = "/tmp/checkpoints"
    return f"{where}/keyloom-{spark.sparkContext.applicationId}"


def unique_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Written to the shared folder (to `path`, for what is dropped before the end) and read back: no lineage before it
    is kept, any executor can read it, and its size is known to the plans that follow."""
    path = path or unique_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes what this application's operators have written to the shared folder; results that were not written
    elsewhere cannot be read any more. For the end of a job."""
    drop(spark, shared_dir(spark))


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, and with them what a task and its Python worker hold, by 2048 for this session
    (unless it is set lower); documents are long, and the default of 10,000 makes batches of tens of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 2048:
        spark.conf.set(key, "2048")


def released() -> None:
    """Gives freed memory of a Python worker back, since workers live on and later stages need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
