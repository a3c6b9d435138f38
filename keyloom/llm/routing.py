"""Brings every pair of equal windows of a corpus to one index, without shipping the corpus.

A window is `k` consecutive units (words or bytes) of a text. Its minimizer, the leftmost of the smallest hashes among
its `m`-unit grams, depends on the window alone. With half of what the window has besides, the minimizer makes the
window's anchor: the gram and the units before it if the window reaches that far to the left, else the gram and the
units behind it, which the window then has. So equal windows have equal anchors, and an anchor is long enough that
unlike windows seldom share one. Consecutive windows with one anchor form a segment; each window is in exactly one, and
no segment has two equal windows. Three rounds over the texts, dealt once into chunks by a hash:

1. A chunk sends the anchors it has (four bytes and a count each, one row for a bucket of them); the buckets answer
   which occur twice in the corpus, and which very often.
2. Only segments with a repeated anchor are sent on: equal ones of a chunk once, with the number of their places
   and their smallest doc_id. An anchor decides the shard. The very frequent ones are cut into single windows dealt by
   their own content, so a passage that a third of the documents share is dealt to all shards, and at most once a chunk.
   A shard indexes its distinct segments, but those that alone have their anchor, and answers for each window of each.
3. A chunk puts the answers to its texts.

All that a task holds is a chunk, a bucket or a shard; their number grows with the corpus. Rows are ordered by content
in every message, so a chunk or shard computed anew after a loss sends the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import fresh, released
from keyloom.llm.hashing import BYTES, ODD, mixed, pieces, word_hashes

LAST = np.iinfo(np.int64).max  # the place of null ids in their order
GROUP = 1 << 18  # units whose hashes are in memory at a time
HEAD = 128  # bytes; longer pieces are quicker taken one by one than eight bytes of all at a time
_U = np.uint64


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    k: int
    m: int  # a power of two
    by_word: bool
    frequent: int = 512  # occurrences beyond which an anchor's segments are cut into windows


@dataclass
class Segments:
    """Segments of some texts; places count units over all the texts."""

    first: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    size: np.ndarray  # units of each text
    data: bytes  # all texts one after the other; of words, each text with one space between words and after it
    begin: np.ndarray | None  # of words: where each begins, and one place more

    def content(self, a: int, b: int) -> bytes:
        return self.data[a:b] if self.begin is None else self.data[self.begin[a] : self.begin[b] - 1]

    def bytes_of(self, first: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the content of so many units begins in the data, and how long it is."""
        if self.begin is None:
            return first, units
        return self.begin[first], self.begin[first + units] - 1 - self.begin[first]


def _grams(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of each m-gram (m a power of two) by doubling."""
    scale, step = ODD, 1
    while step < m:
        h = h[:-step] * _U(scale) + h[step:]
        scale, step = scale * scale % (1 << 64), 2 * step
    return mixed(h)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    step = 1
    while 2 * step <= w:
        h, step = np.minimum(h[:-step], h[step:]), 2 * step
    return np.minimum(h[: len(h) - (w - step)], h[w - step :]) if w > step else h


def _runs(hashes: np.ndarray, size: np.ndarray, u: Units, base: int) -> tuple[np.ndarray, ...]:
    """First unit, windows and anchor of the segments of texts of these sizes."""
    grams = _grams(hashes, u.m)
    n, w, half = len(hashes), u.k - u.m + 1, (u.k - u.m + 1) // 2
    low = _U((1 << 31) - 1)  # the same for all texts: the part of the hashes that decides must be
    ranked = (grams & ~low) | np.arange(len(grams), dtype=_U)  # the smallest, of equal ones the leftmost
    place = (_least(ranked, w) & low).astype(np.int64)
    ends = np.cumsum(size)
    starts, enough = ends - size, size >= u.k
    inside = np.zeros(n + 1, np.int8)
    inside[starts[enough]] += 1
    inside[(ends - u.k + 1)[enough]] -= 1
    valid = np.cumsum(inside[: len(place)], dtype=np.int8) > 0
    left = place - np.arange(len(place)) >= half  # the window reaches `half` units before its minimizer
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (left[1:] != left[:-1]) | (valid[1:] != valid[:-1])
    new[starts[starts < len(place)]] = True
    first = np.flatnonzero(new)
    run = np.diff(first, append=len(place))
    keep = valid[first]
    first, run = first[keep], run[keep]
    p, is_left = place[first], left[first]
    steps = range(0, half, u.m)  # grams that cover the half, each next to or over the one before
    anchor = np.where(is_left, _U(1), _U(2)) + grams[p]
    for j in steps:
        anchor = mixed(anchor * _U(ODD) + grams[np.where(is_left, p - half + j, p + half - j)])
    return first + base, run, anchor


def segments(texts: list[bytes], u: Units) -> Segments:
    if u.by_word:
        texts = [b" ".join(t.split()) for t in texts]
        size = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        data = b"".join([t + b" " for t in texts if t])
        begin = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1])
    else:
        size, data, begin = np.array([len(t) for t in texts], np.int64), b"".join(texts), None
    found, a, base = [], 0, 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + size[b] <= GROUP):
            n, b = n + int(size[b]), b + 1
        if n >= u.k:
            if begin is None:
                hashes = BYTES[np.frombuffer(data, np.uint8, n, base)]
            else:
                part = begin[base : base + n + 1]
                hashes = word_hashes(data[part[0] : part[-1]], part - part[0])
            found.append(_runs(hashes, size[a:b], u, base))
        base += n
        a = b
    cat = lambda j, kind: np.concatenate([x[j] for x in found]) if found else np.zeros(0, kind)
    return Segments(cat(0, np.int64), cat(1, np.int64), cat(2, _U), size, data, begin)


def _dealt(part: np.ndarray, n: int) -> np.ndarray:
    """Order by part, of n parts; within one as before."""
    return np.argsort(part.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")  # 16 bits: a radix sort


def _buckets(anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors in the order of their messages: bucket, value, how often, and for every segment its place."""
    u, place, count = np.unique(anchor, return_inverse=True, return_counts=True)
    bucket, value = (u % _U(n)).astype(np.int64), (u >> _U(32)).astype(np.uint32)
    order = _dealt(bucket, n)  # and in a bucket by anchor, so by value too
    back = np.empty(len(u), np.int64)
    back[order] = np.arange(len(u))
    return bucket[order], value[order], count[order], back[place]


def _answers(rows: pd.DataFrame, kind: int) -> dict[int, bytes]:
    own = rows[rows["kind"] == kind]
    return dict(zip(own["part"].tolist(), own["data"].tolist()))


def _alike(data: bytes, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pieces of `data`, by their bytes: for each piece its content's number, for each content a piece that has it
    and a hash. The contents' order depends on them alone."""
    long = np.flatnonzero(size > HEAD)
    head = np.where(size > HEAD, 0, size)
    h = np.zeros(len(first), _U)
    for live, eight in pieces(data, first, head):
        x = (h[live] ^ eight) * _U(ODD)
        h[live] = x ^ (x >> _U(32))
    h[long] = np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + n]) for a, n in zip(first[long].tolist(), size[long].tolist())), _U, len(long))
    h = mixed(h + size.astype(_U) * _U(ODD))
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    which, lead = np.empty(len(h), np.int64), order[new]
    which[order] = np.cumsum(new) - 1
    other = np.flatnonzero(lead[which] != np.arange(len(h)))
    of = lead[which[other]]
    same = np.array_equal(size[other], size[of])
    same = same and all(np.array_equal(x, y) for (_, x), (_, y) in zip(pieces(data, first[other], head[other]), pieces(data, first[of], head[of])))
    if same and len(long):
        i, j = (x[size[other] > HEAD] for x in (other, of))
        same = all(data[a : a + n] == data[b : b + n] for a, b, n in zip(first[i].tolist(), first[j].tolist(), size[i].tolist()))
    if not same:  # unlike pieces share a hash
        own = list(zip(h.tolist(), (data[a : a + n] for a, n in zip(first.tolist(), size.tolist()))))
        number = {x: i for i, x in enumerate(sorted(set(own)))}
        which = np.array([number[x] for x in own], np.int64)
        lead = np.empty(len(number), np.int64)
        lead[which] = np.arange(len(h))
    return which, lead, h[lead]


@dataclass
class Candidates:
    """The segments of a chunk that are sent, equal ones once, by shard and content."""

    place: np.ndarray  # of each occurrence: first unit
    windows: np.ndarray
    text: np.ndarray  # the text it is in
    content: np.ndarray  # its distinct content
    first: np.ndarray  # of each distinct content: where it begins in the data, and its bytes
    size: np.ndarray
    shard: np.ndarray
    route: np.ndarray  # the anchor, or of a single window a hash of its content
    many: np.ndarray  # windows of each distinct content


def _candidates(s: Segments, u: Units, n: int, flags: dict[int, bytes]) -> Candidates:
    bucket, _, _, place = _buckets(s.anchor, n)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    flat = np.frombuffer(b"".join(flags[int(b)] for b in bucket[cuts]), np.uint8) if len(bucket) else np.zeros(0, np.uint8)
    flag = flat[place] if len(place) else flat
    plain, often = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
    begin, size = s.bytes_of(s.first[plain], s.windows[plain] + (u.k - 1))
    content, lead, _ = _alike(s.data, begin, size)
    # Single windows of the very frequent: by content, which also deals them.
    reps = s.windows[often]
    at = np.repeat(s.first[often], reps) + _nth(reps)
    begin1, size1 = s.bytes_of(at, np.full(len(at), u.k))
    single, lead1, routes = _alike(s.data, begin1, size1)
    content = np.concatenate([content, single + len(lead)])
    route = np.concatenate([s.anchor[plain[lead]], routes])
    many = np.concatenate([s.windows[plain[lead]], np.ones(len(lead1), np.int64)])
    shard = (route % _U(n)).astype(np.int64)
    order = np.argsort(route, kind="stable")  # contents with one route stay in their own order
    order = order[_dealt(shard[order], n)]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    place = np.concatenate([s.first[plain], at])
    of = np.searchsorted(np.cumsum(s.size), place, side="right")
    return Candidates(place, np.concatenate([s.windows[plain], np.ones(len(at), np.int64)]), of, back[content], np.concatenate([begin[lead], begin1[lead1]])[order], np.concatenate([size[lead], size1[lead1]])[order], shard[order], route[order], many[order])


def _nth(reps: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the numbers, one after the other."""
    return np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)


def _cut(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    at = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(at, [*at[1:], len(values)]))


def _packed(*arrays: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *arrays]))


def _unpacked(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<i8", n)
    ends = np.cumsum(sizes) + 8 * n
    return [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]


#: Gets distinct segments, how many places each has, its smallest doc_id; gives for every window of every segment, one
#: after the other, a number.
Index = Callable[[list[bytes], np.ndarray, np.ndarray, Units], np.ndarray]
#: Gets the segments, ids, and for each occurrence's window the place and the number; gives columns for the chunk's texts.
Finish = Callable[[Segments, np.ndarray, np.ndarray, np.ndarray], dict[str, list]]
#: Gets the places and smallest doc_ids of segments that are equal to no other in any window; gives their windows' number.
Settled = Callable[[np.ndarray, np.ndarray], np.ndarray]


def route(docs: DataFrame, u: Units, index: Index, settled: Settled, finish: Finish, schema: str, chunk_bytes: int = 8 << 20, sub_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and finish's columns for every row of `docs` (doc_id, text)."""
    own = fresh(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = own.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    message = "chunk long, kind int, part long, data binary"
    frame = lambda rows: pd.DataFrame(rows, columns=["chunk", "kind", "part", "data"])

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        s = segments(pdf["text"].tolist(), u)
        bucket, value, count, _ = _buckets(s.anchor, n)
        chunk = int(pdf["chunk"].iloc[0])
        return frame([(chunk, 0, int(bucket[a]), value[a:b].astype("<u4").tobytes() + np.minimum(count[a:b], 65535).astype("<u2").tobytes()) for a, b in _cut(bucket)])

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pdf["data"].tolist()
        sizes = np.array([len(r) // 6 for r in raw])
        value = np.concatenate([np.frombuffer(r, "<u4", k) for r, k in zip(raw, sizes)])
        count = np.concatenate([np.frombuffer(r, "<u2", k, 4 * k) for r, k in zip(raw, sizes)]).astype(np.int64)
        _, place = np.unique(value, return_inverse=True)
        often = np.bincount(place, count)[place]
        flags = ((often >= 2).astype(np.uint8) + (often > u.frequent)).astype(np.uint8)
        return frame([(c, 1, p, f.tobytes()) for c, p, f in zip(pdf["chunk"].tolist(), pdf["part"].tolist(), np.split(flags, np.cumsum(sizes)[:-1]))])

    def send(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(replies):
            return frame([])
        s = segments(pdf["text"].tolist(), u)
        c = _candidates(s, u, n, _answers(replies, 1))
        ids = pdf["doc_id"].to_numpy("int64")
        places = np.bincount(c.content, minlength=len(c.first))
        least = np.full(len(c.first), LAST)
        np.minimum.at(least, c.content, ids[c.text])
        chunk, rows = int(pdf["chunk"].iloc[0]), []
        for a, b in _cut(c.shard):
            text = b"".join([s.data[x : x + k] for x, k in zip(c.first[a:b].tolist(), c.size[a:b].tolist())])
            rows.append((chunk, 2, int(c.shard[a]), _packed(c.size[a:b].astype("<i4").tobytes(), text, places[a:b].astype("<i8").tobytes(), least[a:b].astype("<i8").tobytes(), c.route[a:b].astype("<u8").tobytes())))
        return frame(rows)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = list(zip(*(_unpacked(data, 5) for data in pdf["data"])))
        sizes, places, least, routes = (np.concatenate([np.frombuffer(x, kind) for x in got[i]]) for i, kind in ((0, "<i4"), (2, "<i8"), (3, "<i8"), (4, "<u8")))
        sizes, sent = sizes.astype(np.int64), np.array([len(x) // 4 for x in got[0]])
        data = b"".join(got[1])
        begins = np.cumsum(sizes) - sizes
        flat, lead, _ = _alike(data, begins, sizes)
        at = np.split(flat, np.cumsum(sent)[:-1])
        total = np.bincount(flat, places, len(lead)).astype(np.int64)
        low = np.full(len(lead), LAST)
        np.minimum.at(low, flat, least)
        route, first, size = routes[lead], begins[lead], sizes[lead]
        units = size
        if u.by_word:
            spaces = np.cumsum(np.frombuffer(b"\0" + data, np.uint8) == 32, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
            units = (spaces[first + size] - spaces[first]).astype(np.int64) + 1
        windows = units - (u.k - 1)
        ends = np.cumsum(windows)
        out = np.empty(int(ends[-1]), np.int64)
        # Equal windows have one anchor, so a segment that alone has its anchor is equal to itself only.
        _, which, count = np.unique(route, return_inverse=True, return_counts=True)
        alone = count[which] == 1
        w = np.where(alone, windows, 0)
        out[np.repeat(ends - windows - (np.cumsum(w) - w), w) + np.arange(w.sum())] = np.repeat(settled(total, low), w)
        groups = max(1, math.ceil(int(size[~alone].sum()) / sub_bytes))
        of = np.where(alone, -1, ((route >> _U(40)) % _U(groups)).astype(np.int64))
        for g in range(groups):
            mine = np.flatnonzero(of == g)
            mine = mine[np.argsort(route[mine], kind="stable")]  # what is alike is near in memory
            if len(mine):
                got = index([data[a : a + b] for a, b in zip(first[mine].tolist(), size[mine].tolist())], total[mine], low[mine], u)
                w = windows[mine]
                out[np.repeat(ends[mine] - w - (np.cumsum(w) - w), w) + np.arange(w.sum())] = got
        rows = []
        for chunk, part, mine in zip(pdf["chunk"].tolist(), pdf["part"].tolist(), at):
            w = windows[mine]
            v = out[np.repeat(ends[mine] - w - (np.cumsum(w) - w), w) + np.arange(w.sum())]
            new = np.append(np.flatnonzero(np.diff(v)) + 1, len(v))  # runs of one number
            rows.append((chunk, 3, part, _packed(v[new - 1].astype("<i8").tobytes(), np.diff(new, prepend=0).astype("<i8").tobytes())))
        released()
        return frame(rows)

    def put(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", *names])
        s = segments(pdf["text"].tolist(), u)
        ids = pdf["doc_id"].to_numpy("int64")
        where = value = np.zeros(0, np.int64)
        if len(replies):
            c = _candidates(s, u, n, _answers(replies, 1))
            verdicts = _answers(replies, 3)
            got = []
            for a, _ in _cut(c.shard):
                v, run = (np.frombuffer(x, "<i8") for x in _unpacked(verdicts[int(c.shard[a])], 2))
                got.append(np.repeat(v, run))
            if got:
                flat = np.concatenate(got)  # for each window of each distinct content
                starts = np.cumsum(c.many) - c.many
                w = c.windows
                nth = _nth(w)
                where, value = np.repeat(c.place, w) + nth, flat[np.repeat(starts[c.content], w) + nth]
        made = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").mask(pdf["no_id"]), **finish(s, ids, where, value)})
        released()
        return made

    names = [c.split()[0] for c in schema.split(", ")]
    asked = dealt.groupBy("chunk").applyInPandas(ask, message)
    told = asked.groupBy("part").applyInPandas(tell, message)
    sent = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(send, message)
    judged = sent.groupBy("part").applyInPandas(judge, message)
    return dealt.groupBy("chunk").cogroup(told.unionByName(judged).groupBy("chunk")).applyInPandas(put, f"doc_id long, {schema}")
