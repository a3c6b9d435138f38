"""Where results go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.edges import csr_index, edges_to_text, sorted_edges


def sorted_parquet(df: DataFrame, path: str, *keys: str) -> None:
    """Files in key order, each sorted: the range a file covers is in its footer."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def text_edges(edges: DataFrame, path: str) -> None:
    edges_to_text(edges).write.text(path)


def packed(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """part, seq, data: the rows in their order as packed bytes, a piece of up to a million rows in each."""
    kind = np.dtype(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, batch in enumerate(batches):
            rows = np.empty(batch.num_rows, kind)
            for i, (name, _) in enumerate(columns):
                rows[name] = batch.column(i).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([rows.tobytes()], pa.binary())], ["seq", "data"])

    return df.select(*[n for n, _ in columns]).mapInArrow(run, "seq long, data binary").select(F.spark_partition_id().alias("part"), "seq", "data")


def csr_files(edges: DataFrame, path: str, wide: bool = False) -> None:
    """`index` (eight-byte offsets) and `matrix` (four- or eight-byte targets) as ordered packed pieces."""
    size, kind = (8, "<u8") if wide else (4, "<u4")
    packed(csr_index(edges, size).orderBy("id"), [("off", "<u8")]).write.parquet(f"{path}/index")
    packed(sorted_edges(edges), [("dst", kind)]).write.parquet(f"{path}/matrix")


def cursor(df: DataFrame) -> Iterator:
    """The rows in order, a partition at a time."""
    return df.toLocalIterator()
