"""Running values along an order, without one task that sees all rows.

Rows are dealt into blocks of neighbouring positions: where positions are dense, ranges of them; where they are sparse,
the partitions of a range partitioning, written once so that they stay. A block's summary (a row) is scanned over the
blocks, and a window inside each block does the rest. Positions are unique numbers; a null one is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.checkpoints import cut

BLOCK = 1 << 16
SPARSE = 64  # positions a row, from which on ranges of positions would be too many blocks


def _blocked(df: DataFrame, pos: str, block: int) -> DataFrame:
    s = df.agg(F.min(pos).alias("low"), F.max(pos).alias("high"), F.count(pos).alias("n"), F.count("*").alias("rows")).collect()[0]
    if s["n"] < s["rows"]:
        raise ValueError(f"{s['rows'] - s['n']} rows have no position {pos}")
    if s["n"] and s["high"] - s["low"] >= SPARSE * s["n"]:
        return cut(_ranged(df, pos))
    return df.withColumn("_b", F.floor(F.col(pos) / F.lit(block)).cast("long"))


def _ranged(df: DataFrame, *by: str) -> DataFrame:
    return df.repartitionByRange(*by).withColumn("_b", F.spark_partition_id().cast("long"))


def _carried(rows: DataFrame, summary: Column, carry) -> DataFrame:
    """Each row with the scan of the summaries of the blocks before its own, as `_c`."""
    blocks = rows.groupBy("_b").agg(summary.alias("_s"))
    return rows.join(blocks.select("_b", carry(Window.orderBy("_b")).alias("_c")), "_b")


def with_previous(df: DataFrame, pos: str, value: str, out: str, default: object = None, block: int = BLOCK) -> DataFrame:
    """`value` of the row before, by the unique numeric column `pos`."""
    rows = _carried(_blocked(df, pos, block), F.max_by(value, pos), lambda w: F.lag("_s").over(w))
    inside = Window.partitionBy("_b").orderBy(pos)
    first = F.row_number().over(inside) == 1
    got = F.when(first, F.col("_c")).otherwise(F.lag(value).over(inside))
    return rows.withColumn(out, got if default is None else F.coalesce(got, F.lit(default))).drop("_b", "_c")


def with_next(df: DataFrame, pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    rows = _carried(_blocked(df, pos, block), F.min_by(value, pos), lambda w: F.lead("_s").over(w))
    inside = Window.partitionBy("_b").orderBy(pos)
    last = F.lead(pos).over(inside).isNull()
    return rows.withColumn(out, F.when(last, F.col("_c")).otherwise(F.lead(value).over(inside))).drop("_b", "_c")


def with_sum_before(df: DataFrame, pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Sum of `value` over all rows before, 0 for the first."""
    rows = _carried(_blocked(df, pos, block), F.sum(value), lambda w: F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.col("_c") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_b", "_c")


def with_max_before(df: DataFrame, pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    rows = _carried(_blocked(df, pos, block), F.max(value), lambda w: F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.greatest(F.col("_c"), F.max(value).over(inside))).drop("_b", "_c")


def monotone(df: DataFrame, pos: str, value: str) -> DataFrame:
    """Drops the rows whose value is under one seen before."""
    seen = with_max_before(df, pos, value, "_m")
    return seen.where(F.col("_m").isNull() | (F.col(value) >= F.col("_m"))).drop("_m")


def monotone_within(df: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """Drops the rows whose value is under one seen before in their group, along `pos`. A group with very many rows lies
    in several blocks, each of which takes over the largest value of those before. Null groups are one group."""
    rows = cut(_ranged(df, group, pos))
    carried = rows.groupBy("_b", F.col(group).alias("_g")).agg(F.max(value).alias("_s"))
    carried = carried.select(F.col("_b").alias("_at"), "_g", F.max("_s").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    inside = Window.partitionBy("_b", group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_in", F.max(value).over(inside)).join(carried, (F.col("_b") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_g")))
    top = F.greatest("_c", "_in")
    return seen.where(top.isNull() | (F.col(value) >= top)).select(*df.columns)


def order_violations(df: DataFrame, pos: str, key: str, strict: bool = False, row_bytes: int | None = None) -> DataFrame:
    """pos, last, key of the rows whose key is under (strict: not over) the one before. The strict check begins at 0,
    so a first key of 0 is a violation. With `row_bytes`, the offset of the row in a file of such rows."""
    seen = with_previous(df.select(F.col(pos).alias("pos"), F.col(key).alias("key")), "pos", "key", "last", 0 if strict else None)
    bad = seen.where(F.col("key") <= F.col("last") if strict else F.col("key") < F.col("last")).select("pos", "last", "key")
    return bad if row_bytes is None else bad.withColumn("offset", F.col("pos") * row_bytes)
