"""Associative reducers as aggregate Columns: one fold of all values of a key, in any grouping and order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Reducer = Callable[[Column], Column]

U16, U32, U64 = 1 << 16, 1 << 32, 1 << 64


def sum_u32(v: Column) -> Column:
    """Sum modulo 2^32; summed wide, since a BIGINT overflow raises."""
    return F.pmod(F.sum(v.cast("decimal(20,0)")), F.lit(U32).cast("decimal(20,0)")).cast("long")


def sum_u64(v: Column) -> Column:
    """Sum modulo 2^64 of values given as decimals."""
    return F.pmod(F.sum(v.cast("decimal(20,0)")), F.lit(str(U64)).cast("decimal(20,0)")).cast("decimal(20,0)")


def packed16(v: Column) -> Column:
    """Two 16-bit lanes of a number, each summed modulo 2^16."""
    low = F.sum(v.bitwiseAND(U16 - 1)) % U16
    high = F.sum(F.shiftright(v, 16).bitwiseAND(U16 - 1)) % U16
    return (high * U16 + low).cast("long")


def clamped(top: int) -> Reducer:
    """A sum that stays at `top` once it is there (for values of one sign)."""
    return lambda v: F.least(F.sum(v), F.lit(top)).cast("long")


REDUCERS: dict[str, Reducer] = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "first": F.min,  # of an arbitrary order the smallest, so that reruns agree
    "any": F.any_value,
    "avg": F.avg,
    "bit_or": F.bit_or,
    "bit_and": F.bit_and,
    "bit_xor": F.bit_xor,
    "bool_or": F.bool_or,
    "bool_and": F.bool_and,
    "distinct": F.count_distinct,
    "sum_u32": sum_u32,
    "sum_u64": sum_u64,
    "packed16": packed16,
    "clamp_u32": clamped(U32 - 1),
}


class Custom:
    """Any associative and commutative update of two values. As an aggregate it folds the values of a group that meet in
    one row; `reduce_by_key` therefore gives it groups of bounded size (see `partial`)."""

    def __init__(self, update: Callable[[Column, Column], Column]):
        self.update = update

    def __call__(self, v: Column) -> Column:
        values = F.collect_list(v)
        return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), self.update)

    def partial(self, rows: DataFrame, block: int = 1 << 14, salts: int = 1 << 12) -> DataFrame:
        """key, value: folded first within each task's blocks of rows, then by key and salt, so that a hot key never
        meets in one row: at most `block` values, then its blocks over `salts`, then `salts`."""
        place = F.struct(F.spark_partition_id(), F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / block))
        blocks = rows.withColumn("_at", place).groupBy("key", "_at").agg(self(F.col("value")).alias("value"))
        salted = blocks.groupBy("key", F.pmod(F.xxhash64("_at"), F.lit(salts)).alias("_salt")).agg(self(F.col("value")).alias("value"))
        return salted.select("key", "value")


def custom(update: Callable[[Column, Column], Column]) -> Custom:
    return Custom(update)


def reducer(by: str | Reducer | None) -> Reducer:
    if by is None:
        raise ValueError("a reducer is needed: a name or a function of a Column")
    if isinstance(by, str):
        if by not in REDUCERS:
            raise ValueError(f"unknown reducer {by!r}; known: {', '.join(sorted(REDUCERS))}")
        return REDUCERS[by]
    return by
