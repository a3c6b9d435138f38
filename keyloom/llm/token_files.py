"""Token ids in a compact file format: canonical length-limited Huffman codes from global counts.

Ids are encoded once and counted (at most one sum for each id of the vocabulary reaches the driver); package-merge
gives code lengths of at most `LIMIT` bits (more where the vocabulary needs it), and only the lengths are kept, since
canonical codes follow from them. Between the passes ids take two bytes each where they fit. Documents in ascending
doc_id order are cut into independent blocks: a row of the files has a block's documents (ids and lengths), its bits,
and the bit offset of every `STEP`-th id. A reader decodes all stretches between these offsets at once with one table
lookup an id.

Files under the path: `blocks/` (Parquet as the container: a lost executor's part is written anew and only whole parts
are seen), `lengths/` (id, code length). Defined cases: null and empty texts hold the end id alone; null doc_ids come
first; rows with one doc_id are ordered by the checksum of their ids; other columns are ignored; an empty table makes
files without blocks. A doc_id with many rows is split over ranges by that checksum.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import drop, fresh, released, small_batches, unique_path
from keyloom.llm.encoding import encoder, in_groups

LIMIT, STEP = 20, 256
BLOCK_IDS, PART_IDS, MAX_PARTS = 1 << 17, 1 << 22, 50_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: code lengths of the ids with a count, 0 for the others."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, math.ceil(math.log2(len(used))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    lists, row = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(limit):
        lists.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        row, is_leaf = both[by], by < len(leaves)
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves) + 1, np.int64)
    for flags in reversed(lists):  # of the cheapest `take` items, the leaves are the rarest ids; packages open below
        n = int(flags[:take].sum())
        depth[0] += 1
        depth[n] -= 1
        take = 2 * (take - n)
    out[order] = np.cumsum(depth[:-1])
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max(initial=1))
    step = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.uint64)
    out = np.zeros(len(lengths), np.uint64)
    out[order] = first >> (np.uint64(top) - lengths[order].astype(np.uint64))
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids in big-endian 64-bit words, and the bit offset of every STEP-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    out = np.zeros(int(ends[-1] >> 6) + 3 if len(ends) else 2, np.uint64)
    if len(ids):
        c, word, over = code[ids], at >> 6, (at & 63) + n - 64
        fits = over <= 0
        high = np.where(fits, c << np.maximum(-over, 0).astype(np.uint64), c >> np.maximum(over, 0).astype(np.uint64))
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[edge]] = np.add.reduceat(high, edge)  # bits of one word do not meet, so a sum joins them
        rest = np.flatnonzero(~fits)
        out[word[rest] + 1] += c[rest] << (64 - over[rest]).astype(np.uint64)
    return out.astype(">u8").tobytes(), at[::STEP]


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next `top` bits: the id, and its length."""
    top = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    many = np.int64(1) << (top - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    ids[: many.sum()], size[: many.sum()] = np.repeat(order, many), np.repeat(lengths[order], many)
    return ids, size, top


def unpack(bits: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All stretches between offsets advance together, an id a step."""
    ids, size, top = table
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    out = np.zeros((STEP, len(offsets)), np.uint32)
    at, mask = offsets.astype(np.int64), np.uint64((1 << top) - 1)
    for step in range(min(STEP, n)):
        if step == n - (len(offsets) - 1) * STEP:
            at = at[:-1]  # the last stretch is over
        if not len(at):
            break
        w = at >> 5
        seen = ((words[w] << np.uint64(32)) | words[w + 1]) >> (64 - top - (at & 31)).astype(np.uint64) & mask
        out[step, : len(at)] = ids[seen]
        at = at + size[seen]
    return out.T.reshape(-1)[:n]


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def _wide(raw: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<u2" if raw.as_buffer().size == 2 * n else "<u4")


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n, crc, ids (see `_narrow`) with the end id, in no order; and for every task a row with n = -1 whose ids
    are its counts of all ids, as eight-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, total, kind = encoder(path), np.array([end_id], np.uint32), np.zeros(end_id + 1, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for a, b in in_groups(texts):
                own = [np.concatenate([x, end]) for x in enc.ids(texts[a:b])]
                c = np.bincount(np.concatenate(own), minlength=len(total))
                c[: len(total)] += total
                total = c
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.astype("<u4", copy=False)) for x in own], pa.int64()), pa.array([_narrow(x) for x in own], pa.binary())], ["doc_id", "n", "crc", "ids"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["doc_id", "n", "crc", "ids"])
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return fresh(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, crc long, ids binary")


def _counted(tasks: DataFrame) -> DataFrame:
    """id, n over all tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                c = np.frombuffer(raw.as_buffer(), "<i8").copy()
                if len(c) < len(total):
                    c, total = total, c
                c[: len(total)] += total
                total = c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tasks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first, held, docs = codes(lengths), 0, [], []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bits, offsets = pack(ids, lengths, code)
            row = [[first], [len(ids)], [[d for d, _ in docs]], [np.array([n for _, n in docs], "<i8").tobytes()], [bits], [offsets.astype("<i8").tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.list_(batch.column(0).type), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["first", "n", "doc_ids", "sizes", "bits", "offsets"])

        size = 0
        for batch in batches:
            for doc, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = _wide(raw, n)
                held.append(ids)
                docs.append((doc, len(ids)))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
                    first, held, docs, size = first + size, [], [], 0
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, out: str, end_id: int = 2) -> str:
    """Writes the files of `docs` under `out`."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = f"{out}/raw"
    encoded(docs, path, end_id).write.option("compression", "zstd").parquet(raw)
    rows = spark.read.parquet(raw)
    counts = {r["id"]: r["n"] for r in _counted(rows.where("n < 0")).collect()}  # at most the vocabulary
    n = np.zeros(max(counts, default=0) + 1, np.int64)
    n[list(counts)] = list(counts.values())
    lengths = code_lengths(n)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int").coalesce(1).write.parquet(f"{out}/lengths")
    parts = min(MAX_PARTS, max(1, math.ceil(int(n.sum()) / PART_IDS)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = rows.where("n >= 0").repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc").select("doc_id", "n", "ids")
    coded = ranged.mapInArrow(_blocks(lengths), f"first long, n long, doc_ids array<{kind}>, sizes binary, bits binary, offsets binary")
    coded.select(F.spark_partition_id().alias("part"), "*").write.option("compression", "none").parquet(f"{out}/blocks")
    drop(spark, raw)
    return out


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document in the files."""
    blocks = spark.read.parquet(f"{out}/blocks")
    before, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # at most MAX_PARTS numbers
        before[r["part"]] = total
        total += r["n"]
    made = {r["id"]: r["length"] for r in spark.read.parquet(f"{out}/lengths").collect()}
    lengths = np.zeros(max(made, default=0) + 1, np.uint8)
    lengths[list(made)] = list(made.values())
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, n, docs, many, bits, offsets = (batch.column(c)[row] for c in range(7))
                ids = unpack(bits.as_py(), np.frombuffer(offsets.as_py(), "<i8"), n.as_py(), table).astype("<u4")
                size = np.frombuffer(many.as_py(), "<i8")
                ends = np.cumsum(size)
                own = [x.tobytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(before[part.as_py()] + first.as_py() + ends - size), pa.array(size), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.select("part", "first", "n", "doc_ids", "sizes", "bits", "offsets").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes `docs` to new files in the shared folder and gives what they hold."""
    out = write(docs, path, unique_path(docs.sparkSession, "token-ids"), end_id)
    return read(docs.sparkSession, out)
