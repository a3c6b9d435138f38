"""Where updates, edges and reads come from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_edges(spark: SparkSession, path: str) -> DataFrame:
    """Lines `src<blank>dst`; what follows is ignored, lines without two numbers are left out."""
    parts = F.split(F.btrim("value"), "[ \t]+")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("long").alias("src"), F.get(parts, F.lit(1)).try_cast("long").alias("dst")).where("src is not null and dst is not null")


def _decoded(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind)
            places = batch.column(0)
            yield pa.RecordBatch.from_arrays([places, *(pa.array(rows[n].astype(np.int64)) for n in kind.names)], ["pos", *kind.names])

    return run


def binary_rows(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Packed fixed-width rows of numpy types, e.g. [("src", "<u8"), ("dst", "<u8")]; all columns become BIGINT, with the
    row's place in the file (of several files, one after the other). Files are split between rows, whatever their size."""
    kind = np.dtype(fields)
    encoders = spark._jvm.org.apache.spark.sql.Encoders
    records = spark._jsc.binaryRecords(path, kind.itemsize).zipWithIndex()
    made = spark._jsparkSession.createDataset(records.rdd(), encoders.tuple(encoders.BINARY(), encoders.LONG()))
    rows = DataFrame(made.toDF(), spark).toDF("data", "pos").select("pos", "data")
    return rows.mapInArrow(_decoded(kind), "pos long, " + ", ".join(f"{n} long" for n, _ in fields))


def unpacked(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """part, seq, place and the fields of what `sinks.packed` made: the order of the rows is that of these three."""
    kind = np.dtype(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(i) for i in range(3))):
                rows = np.frombuffer(raw.as_buffer(), kind)
                own = [pa.array(np.full(len(rows), x.as_py(), np.int64)) for x in (part, seq)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(len(rows))), *(pa.array(rows[n].astype(np.int64)) for n in kind.names)], ["part", "seq", "place", *kind.names])

    return spark.read.parquet(path).select("part", "seq", "data").mapInArrow(run, "part long, seq long, place long, " + ", ".join(f"{n} long" for n, _ in fields))


def fastq(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """id, seq: the second of each four lines; empty ones are left out. Files are split anywhere, and lines are numbered
    after that, so every file must have whole records (a multiple of four lines)."""
    encoders = spark._jvm.org.apache.spark.sql.Encoders
    numbered = spark._jsc.textFile(path).zipWithIndex()
    lines = DataFrame(spark._jsparkSession.createDataset(numbered.rdd(), encoders.tuple(encoders.STRING(), encoders.LONG())).toDF(), spark).toDF("seq", "pos")
    reads = lines.where("pos % 4 = 1 and seq <> ''").select(F.expr("pos div 4").alias("id"), F.regexp_replace("seq", "\r$", "").alias("seq"))
    return reads.where("id = 0") if first_only else reads


#: One step of the pseudo-random sequence that both engines can compute without overflow.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 1 << 31


def lcg(x: Column) -> Column:
    return (x * LCG_A + LCG_C) % LCG_M


def rmat(spark: SparkSession, scale: int = 5, edge_factor: int = 1, seed: int = 1) -> DataFrame:
    """src, dst: a recursive-matrix graph of 2^scale nodes. In each of `scale` rounds a number under 1024 picks the
    quadrant: under 583, 777 and 971, else the last; the numbers are a function of the edge, so reruns agree."""
    df = spark.range((1 << scale) * edge_factor).select("id", (F.col("id") * 2654435 + seed).alias("_x"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    df = df.withColumn("_x", F.col("_x") % LCG_M)
    for _ in range(scale):
        df = df.withColumn("_x", lcg(F.col("_x"))).withColumn("_r", F.shiftright("_x", 16) % 1024)
        df = df.select("id", "_x", (F.col("src") * 2 + (F.col("_r") >= 777).cast("long")).alias("src"), (F.col("dst") * 2 + (((F.col("_r") >= 583) & (F.col("_r") < 777)) | (F.col("_r") >= 971)).cast("long")).alias("dst"))
    return df.select("id", "src", "dst")


def quadrants(edges: DataFrame, scale: int) -> DataFrame:
    """How many edges begin in each quadrant."""
    half = 1 << (scale - 1)
    return edges.groupBy((F.col("src") >= half).cast("int").alias("down"), (F.col("dst") >= half).cast("int").alias("right")).agg(F.count("*").alias("n"))


def random_updates(spark: SparkSession, n: int, mask: int = 0xFFFFF) -> DataFrame:
    """key, value = 1: n updates with keys spread over the mask."""
    x = (F.col("id") * 2654435 + 1) % LCG_M
    return spark.range(n).select(lcg(lcg(x)).bitwiseAND(mask).alias("key"), F.lit(1).cast("long").alias("value"))


def defaults(spark: SparkSession, vertices: int, value: Column) -> DataFrame:
    return spark.range(vertices).select("id", F.lit(0).alias("iteration"), value.alias("val"))
