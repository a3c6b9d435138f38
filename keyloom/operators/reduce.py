"""Reduce by key, in key order: the operator everything else rests on."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.reducers import Custom, Reducer, reducer


def reduce_by_key(df: DataFrame, key: str | Column, value: str | Column, by: str | Reducer | None, ordered: bool = True, one_shuffle: bool = False, nulls: str = "drop") -> DataFrame:
    """key, value: one row a key, ascending. Values are combined before the exchange.

    `one_shuffle` deals the raw rows by key range once and aggregates and sorts where they are: for keys that hardly
    repeat, where combining first saves nothing. A null key is dropped, or raises with `nulls="raise"`; a null value
    is no update. Empty input gives an empty result."""
    named = df.select((F.col(key) if isinstance(key, str) else key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value"))
    if nulls == "raise":
        named = named.withColumn("key", F.coalesce("key", F.raise_error(F.lit("null key")).cast(named.schema["key"].dataType)))
    named = named.where("key is not null and value is not null")
    if isinstance(by, Custom):
        named = by.partial(named)
    elif one_shuffle:
        named = named.repartitionByRange("key")
    out = named.groupBy("key").agg(reducer(by)(F.col("value")).alias("value"))
    return out.orderBy("key") if ordered else out


def reduce_columns(df: DataFrame, key: str | Column, values: dict[str, Column], by: str | Reducer = "sum", ordered: bool = True) -> DataFrame:
    """Element-wise reduction of a vector of values: key and one column a lane."""
    k = (F.col(key) if isinstance(key, str) else key).alias("key")
    lanes = df.select(k, *[v.alias(n) for n, v in values.items()]).where("key is not null")
    out = lanes.groupBy("key").agg(*[reducer(by)(F.col(n)).alias(n) for n in values])
    return out.orderBy("key") if ordered else out


def union_all(inputs: list[DataFrame]) -> DataFrame:
    """Several producers of one operator."""
    if not inputs:
        raise ValueError("no input")
    return fold(DataFrame.unionByName, inputs)


def summary(reduced: DataFrame) -> DataFrame:
    """n_keys, total, max_key of a reduced table."""
    return reduced.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"), F.max("key").alias("max_key"))


def golden_compare(result: DataFrame, golden: DataFrame) -> DataFrame:
    """How many keys agree, differ, are not in the golden table, or are left over in it."""
    r, g = result.select("key", F.col("value").alias("rv")), golden.select("key", F.col("value").alias("gv"))
    both = r.withColumn("inr", F.lit(True)).join(g.withColumn("ing", F.lit(True)), "key", "full_outer")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return both.agg(
        count(F.col("inr") & F.col("ing") & F.col("rv").eqNullSafe(F.col("gv"))).alias("correct"),
        count(F.col("inr") & F.col("ing") & ~F.col("rv").eqNullSafe(F.col("gv"))).alias("mismatch"),
        count(F.col("inr") & F.col("ing").isNull()).alias("nonexist"),
        count(F.col("ing") & F.col("inr").isNull()).alias("left_over"),
    )


@dataclass
class Status:
    """What a caller may ask while it runs: inputs given and rows known of, whether the input has ended, and whether the
    result exists, with its rows, bytes and files (of a result that was written)."""

    inputs: int = 0
    done_input: bool = False
    started: bool = False
    done: bool = False
    rows: int = 0
    bytes: int = 0
    files: int = 0
    path: str | None = None


@dataclass
class KeyedLog:
    """A reduce operator that is fed input by input: `update` adds a producer's rows, `finish` ends the input, and
    `result` is the lazy reduced table, `rows` its rows in key order, `write` its file."""

    by: str | Reducer | None = None
    ordered: bool = True
    status: Status = field(default_factory=Status)
    _inputs: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        reducer(self.by)

    def update(self, rows: DataFrame) -> bool:
        """False once the input is finished."""
        if self.status.done_input:
            return False
        self._inputs.append(rows.select("key", "value"))
        self.status.inputs += 1
        return True

    def finish(self) -> None:
        self.status.done_input = True

    def result(self) -> DataFrame:
        if not self.status.done_input:
            raise RuntimeError("the input is not finished")
        self.status.started = True
        return reduce_by_key(union_all(self._inputs), "key", "value", self.by, self.ordered)

    def rows(self):
        """The rows in key order, a partition at a time."""
        for r in self.result().toLocalIterator():
            self.status.rows += 1
            yield r["key"], r["value"]
        self.status.done = True

    def write(self, path: str) -> str:
        result = self.result()
        result.write.parquet(path)
        files = result.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).collect()[0]
        self.status.rows, self.status.files, self.status.bytes = result.sparkSession.read.parquet(path).count(), files["n"], files["size"]
        self.status.path, self.status.done = path, True
        return path
