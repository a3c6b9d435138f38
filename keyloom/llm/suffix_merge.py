"""Suffix-array dedup of bytes by merging Burrows-Wheeler transforms.

Windows of `k` bytes meet in shards (see `routing`). The distinct segments of a shard are split into blocks; each
block's transform is made by itself, and the transforms are merged by refining their interleave: suffixes in the order
of their first h symbols are dealt, in that order, by the symbols before them, which gives the order by h + t symbols.
No suffix is compared again. The round in which a suffix starts a new class tells its common prefix with the one
before; classes left after `k` symbols are the repeated intervals, and the smallest doc_id in an interval is the first
document with that string.

Defined cases: null and empty texts have no bytes; texts under `k` bytes have no window; a string that occurs twice in
one document only is not removed; rows with the same doc_id are as one document; null doc_ids come last and do not
precede each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from keyloom.llm.routing import LAST, Segments, Units, route
from keyloom.llm.substring_fm import covered

BLOCK = 1 << 19


def _bits(top: int) -> int:
    return max(1, int(top).bit_length())


def _grams(text: np.ndarray, t: int, bits: int) -> np.ndarray:
    """t symbols from each place on, the text as a ring, as one number."""
    out, done, part, width = np.zeros(len(text), np.int64), 0, text.astype(np.int64), 1
    while t:
        if t & 1:
            out, done = (out << (bits * width)) | np.roll(part, -done), done + width
        t >>= 1
        if t:
            part, width = (part << (bits * width)) | np.roll(part, -width), 2 * width
    return out


def block_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the ring by at least their first `depth` symbols."""
    bits = _bits(text.max())
    known, width = 63 // bits, _bits(len(text))
    key, parts = _grams(text, known, bits), min(3, 63 // width)  # so many ranks make the next key
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        ranked = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        key = rank
        for j in range(1, parts):
            key = (key << width) | np.roll(rank, -j * known)
        known *= parts


def merge(texts: list[np.ndarray], orders: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (counted over all blocks) in the order of their first `depth` symbols, and each one's common prefix
    with the place before: a lower bound under `depth`, or `depth`."""
    rows = len(texts)
    offset = np.cumsum([0, *(len(t) for t in texts)])
    n = int(offset[-1])
    place = np.concatenate([o + a for o, a in zip(orders, offset)])
    bits, low = _bits(max(t.max() for t in texts)), _bits(n)
    t = min(depth, 63 // bits)  # symbols a round: as many as make one number
    before = np.concatenate([np.roll(_grams(x, t, bits), t)[o] for x, o in zip(texts, orders)])
    steps = [t] * (depth // t) + ([depth % t] if depth % t else [])
    source = np.repeat(np.arange(rows, dtype=np.uint8 if rows < 256 else np.uint16), np.diff(offset))
    block, starts = np.zeros(n, np.int32), np.zeros(n, bool)
    prefix = np.full(n, depth, np.int32)
    code, h = None, 0
    for step in steps:
        if code is None or step != t:
            code = np.unique(before & ((1 << (bits * step)) - 1), return_inverse=True)[1] << low
        key = np.sort(code[_own_places(source, offset)] | np.arange(n))  # by symbols, equal ones as before
        dealt = key & ((1 << low) - 1)
        symbol = key >> low
        source, block = source[dealt], block[dealt]
        new = np.ones(n, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32)
        prefix[new & ~starts] = h  # a class begins where it began before, or is a new one
        starts, h = new, h + step
    return place[_own_places(source, offset)], prefix


def _own_places(source: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For each place of the interleave, its suffix: each block's suffixes come in the block's own order."""
    n = len(source)
    if len(offset) == 2:
        return np.arange(n)
    if len(offset) == 3 and n < 1 << 31:
        second = np.cumsum(source, dtype=np.int32)
        return np.where(source, second + np.int32(offset[1] - 1), np.arange(n, dtype=np.int32) - second)
    out = np.empty(n, np.int64)
    out[np.argsort(source, kind="stable")] = np.arange(n)
    return out


def first_documents(texts: list[bytes], places: np.ndarray, least: np.ndarray, u: Units) -> np.ndarray:
    """For each window of each text, the smallest doc_id that has its string."""
    size = np.array([len(t) for t in texts], np.int64)
    windows = size - u.k + 1
    if len(texts) == 1:
        return np.full(int(windows[0]), least[0])  # any string of it has the same first document
    blocks: list[list[bytes]] = [[]]
    room = BLOCK
    for t in texts:
        if room < 0:
            blocks.append([])
            room = BLOCK
        blocks[-1].append(t)
        room -= len(t) + 1
    rings = []
    present = np.zeros(257, bool)
    present[0] = True
    for own in blocks:
        present[np.unique(np.frombuffer(b"".join(own), np.uint8)) + np.int64(1)] = True
    symbol = np.cumsum(present) - 1  # only as many as there are, so that more of them make a number
    for own in blocks:
        n = np.array([len(t) + 1 for t in own])
        ring = np.zeros(int(n.sum()), np.int64)
        inner = np.ones(len(ring), bool)
        inner[np.cumsum(n) - 1] = False
        ring[inner] = symbol[1:][np.frombuffer(b"".join(own), np.uint8)]
        rings.append(ring)
    place, prefix = merge(rings, [block_order(r, u.k + 5) for r in rings], u.k)
    # For a window its segment's smallest doc_id; other suffixes are no window and precede nothing.
    begin = np.cumsum(size + 1) - (size + 1)
    first = np.full(int((size + 1).sum()), LAST)
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(begin, windows) + nth
    first[at] = np.repeat(least, windows)
    starts = np.flatnonzero(prefix < u.k)
    smallest = np.minimum.reduceat(first[place], starts)
    out = np.empty(len(first), np.int64)
    out[place] = np.repeat(smallest, np.diff(np.append(starts, len(place))))
    return out[at]


def dedup_bytes(docs: DataFrame, k: int = 50, m: int = 16, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for every row."""

    def finish(s: Segments, ids: np.ndarray, where: np.ndarray, value: np.ndarray) -> dict[str, list]:
        ends = np.cumsum(s.size)
        own = ids[np.searchsorted(ends, where, side="right")]
        gone = covered(len(s.data), where[value < own], k)
        data = np.frombuffer(s.data, np.uint8)
        begins = (ends - s.size)[s.size > 0]
        edge = np.zeros(len(gone) + 1, bool)  # where a span begins or the one before ends; none passes from text to text
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[begins] = edge[-1] = True
        cuts = np.flatnonzero(edge)
        cuts, length = cuts[:-1], np.diff(cuts)
        cuts, length = cuts[gone[cuts]], length[gone[cuts]]
        of = np.searchsorted(ends, cuts, side="right")
        lost = np.bincount(of, length, len(ends)).astype(np.int64)
        left, stay = np.frombuffer(s.data, np.uint8)[~gone].tobytes(), np.cumsum(s.size - lost)
        kept = [left[a:b] for a, b in zip((stay - (s.size - lost)).tolist(), stay.tolist())]
        return {"n_bytes": s.size, "n_removed": lost, "n_spans": np.bincount(of, minlength=len(ends)), "kept": kept}

    frequent = {"frequent": sizes.pop("frequent")} if "frequent" in sizes else {}
    return route(docs, Units(k, m, False, **frequent), first_documents, lambda places, least: least, finish, "n_bytes long, n_removed long, n_spans long, kept binary", **sizes)
