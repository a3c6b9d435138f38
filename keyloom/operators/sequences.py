"""k-mers and what follows them, and gathering rows by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS = 500_000  # characters whose windows are counted together


def _distinct(text: str, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each different window of `span` characters is first met, and how many there are, in texts of these sizes
    that lie one after the other. Windows are numbered by doubling: as many characters as a number holds, then twice."""
    at, names = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
    bits = max(1, int(len(at) - 1).bit_length())
    width = min(span, 62 // bits)
    rank = names[: len(names) - width + 1].astype(np.int64)
    for j in range(1, width):
        rank = (rank << bits) | names[j : len(names) - width + 1 + j]
    while width < span:
        rank = np.unique(rank, return_inverse=True)[1]
        step = min(width, span - width)
        rank, width = rank[:-step] * (int(rank.max()) + 1) + rank[step:], width + step
    ends = np.cumsum(sizes)
    inside = np.zeros(len(names) + 1, np.int64)
    np.add.at(inside, ends - sizes, 1)
    np.add.at(inside, ends - span + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(rank)] > 0)
    _, first, count = np.unique(rank[starts], return_index=True, return_counts=True)
    return starts[first], count


def windows(df: DataFrame, text: str, k: int, after: int = 1) -> DataFrame:
    """kmer, nxt, n: every `k` characters of a text that are followed by `after` more, counted within pieces of the input
    (so that what is shuffled are different ones); the same window may come from several pieces."""
    span = k + after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0

        def counted() -> pa.RecordBatch:
            whole = "".join(held)
            at, n = _distinct(whole, np.array([len(t) for t in held], np.int64), span)
            kmer = [whole[a : a + k] for a in at.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(kmer, pa.string()), pa.array([whole[a + k : a + span] for a in at.tolist()], pa.string()), pa.array(n)], ["kmer", "nxt", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and len(t) >= span:
                    held.append(t)
                    size += len(t)
                    if size >= CHARS:
                        yield counted()
                        held, size = [], 0
        if held:
            yield counted()

    return df.select(F.col(text).alias("t")).mapInArrow(run, "kmer string, nxt string, n long")


def kmer_count(df: DataFrame, text: str, k: int) -> DataFrame:
    return windows(df, text, k).groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_next(df: DataFrame, text: str, k: int, alphabet: str = "ACGT") -> DataFrame:
    """kmer and for each letter how often it follows."""
    return windows(df, text, k).groupBy("kmer").agg(*[F.sum(F.when(F.col("nxt") == c, F.col("n")).otherwise(0)).alias(f"n_{c.lower()}") for c in alphabet])


def kmer_lines(profile: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """Lines of two bits a base (in the alphabet's order; unknown letters as its first) and the counts."""
    bits = F.array_join(F.transform(F.split("kmer", ""), lambda c: F.lpad(F.bin(F.greatest(F.instr(F.lit(alphabet), c) - 1, F.lit(0))), 2, "0")), "")
    return profile.select(F.concat_ws(" ", bits, *[F.col(f"n_{c.lower()}").cast("string") for c in alphabet]).alias("line"))


def gather(requests: DataFrame, table: DataFrame, index: str, value: str | Column) -> DataFrame:
    """pos, idx, value for requests (pos, idx), in the order they were made; an index without a row is left out."""
    rows = table.select(F.col(index).alias("idx"), (F.col(value) if isinstance(value, str) else value).alias("value"))
    return requests.join(rows, "idx").select("pos", "idx", "value").orderBy("pos")
