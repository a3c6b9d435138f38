"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Neighbouring chunks are spliced at a place inside their
overlap where both have a token boundary and where the vocabulary's pattern is proven to split whatever stands around
it; where the overlap has none, it is widened, and in the end the chunk itself grows. Huge is what has over `huge`
characters (8192 by default); other documents are encoded at once, from a cache of pieces between proven boundaries.

Defined cases: null and empty texts have 0 bytes and 0 tokens; rows are counted each by itself, so repeated rows, ties
and null ids need nothing; other input columns are ignored; an empty table gives an empty result. Nothing is shuffled;
a task holds one Arrow batch and a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import fresh, released, small_batches
from keyloom.llm.encoding import Encoder, encoder, in_groups, is_cut


def resync_count(enc: Encoder, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text that is encoded in chunks of `chunk` characters."""
    if not enc.by_piece:  # no proven boundary: only the whole text is right
        return int(enc.counts([text])[0])

    def starts(a: int, b: int) -> np.ndarray:
        return np.array([x for x, _ in enc.tokenizer.encode(text[a:b], add_special_tokens=False).offsets], np.int64) + a

    total, begin, end = 0, 0, min(len(text), chunk)
    left = starts(begin, end)  # tokens from `begin`, which is a proven boundary
    while end < len(text):
        wide = overlap
        while True:
            a = max(begin, end - wide)
            right_end = min(len(text), a + max(chunk, 2 * wide))
            right = starts(a, right_end)
            # Of the overlap's last places none counts whose right side the left chunk does not see.
            common = np.intersect1d(left, right)
            p = next((int(x) for x in common[::-1] if a < x < end - 1 and is_cut(text, int(x))), None)
            if p is not None:
                break
            if a == begin:  # the whole left chunk has no boundary: take both as one
                left, end = starts(begin, right_end), right_end
                break
            wide *= 2
        if p is None:
            if end >= len(text):
                break
            chunk = max(chunk, 2 * (end - begin))
            continue
        total += int(np.searchsorted(left, p))
        begin, end, left = p, right_end, right[np.searchsorted(right, p) :]
    return total + len(left)


def spliced_counts(enc: Encoder, texts: list[str], chunk: int, overlap: int) -> list[int]:
    """`resync_count` of many texts, whose chunks go to the library together. A text whose chunks do not meet at a
    proven boundary in the first overlap is done again by itself, with wider ones."""
    if not enc.by_piece:
        return enc.counts(texts).tolist()
    step = chunk - overlap
    begins = [list(range(0, max(1, len(t) - overlap), step)) for t in texts]
    parts = enc.tokenizer.encode_batch([t[b : b + chunk] for t, bs in zip(texts, begins) for b in bs], add_special_tokens=False)
    found, at = [], 0
    for text, bs in zip(texts, begins):
        starts = [np.array([x for x, _ in e.offsets], np.int64) + b for e, b in zip(parts[at : at + len(bs)], bs)]
        at += len(bs)
        total, before = 0, 0
        for left, right, b in zip(starts, starts[1:], bs):
            common = np.intersect1d(left[np.searchsorted(left, b + step) :], right)
            p = next((int(x) for x in common[::-1] if b + step < x < b + chunk - 1 and x > before and is_cut(text, int(x))), None)
            if p is None:
                total = resync_count(enc, text, chunk, 2 * overlap)
                break
            total += int(np.searchsorted(left, p) - np.searchsorted(left, before))
            before = p
        else:
            total += len(starts[-1]) - int(np.searchsorted(starts[-1], before))
        found.append(total)
    return found


def count_tokens(docs: DataFrame, path: str, limit: int = 512, huge: int = 8192, chunk: int = 4096, overlap: int = 96) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`. Texts of over `huge` characters are chunked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            for counted, own in ((enc.counts, [i for i, t in enumerate(texts) if len(t) <= huge]), (lambda x: spliced_counts(enc, x, chunk, overlap), [i for i, t in enumerate(texts) if len(t) > huge])):
                part = [texts[i] for i in own]
                for a, b in in_groups(part):
                    n[own[a:b]] = counted(part[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])
        released()

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = fresh(docs, "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = own.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
