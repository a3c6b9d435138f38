"""Near-duplicate documents by bottom-k MinHash sketches.

One hash function gives every word shingle a number; a document's sketch is its `k` smallest numbers. Documents with
equal sets are one class, and only classes are compared.

Isolated classes. Two sets that reach the similarity share at least `shared` retained values (surely for sets whose
difference cannot push more of them out, else but for a chance of 1e-9 at the very threshold). A class with too few
values that any other class retains has no link; most are done with this, in one count of values, `PRUNED` times over
what is left.

Inverted lists. Each class that is left enters the lists of its rarest values among its `g` smallest, all but the
`shared - 1` most frequent ones, by frequency in what is left. `exact=True` retains whole sets, which leaves nothing to
chance. An entry takes its class's sketch along, as `FINGER` bits of each value in the order of the values: values that
differ may look equal there, which excludes no pair, and those that look equal within a set are allowed for.

Candidates. A list never gives pairs, only as many edges as it has members: a tree over each component of the pairs in
it that share enough retained values and pass an estimate from the union of both sketches. Lists grow with the input
while their members stay unlike, so what members have in common is counted along the values of one against those that no
edge has reached. Lists of more than `LONG` members are cut into blocks, and each two blocks make a list. So groups that
the edges join hold all links, and the text of each of their classes goes to its group once.

Links. Within a group the exact similarity of the full sets decides. A group is measured by a leader L first: sets that
are linked with it are one component, and any two sets share at most min(|A & L|, |B & L|) values of L and the lesser
count of their others that recur in the group, which leaves few pairs to compare. Groups of more than `GROUP` values are
cut into blocks, and each two blocks go to a task. Only in lists and groups that are cut do rows grow with the square.

Defined cases: null texts and texts without words have no shingle, no link and their own id as component; fewer words
than a shingle has make one shingle; equal texts are linked; rows that share a doc_id stand for themselves and may be
in different components; a null doc_id links like any but is never a component's id unless all its ids are null; a
doc_id may be of any type with an order; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, drop, released, row_key, small_batches, unique_path
from keyloom.llm.encoding import in_groups
from keyloom.llm.hashing import mixed, word_hashes

#: Up to so many ids or 16-byte keys are broadcast (about 100 MB at most in memory); beyond, joins shuffle.
BROADCAST_KEYS = 500_000
PRUNED = 2  # counts of values that take isolated classes out
FULL = 64  # members of a list up to which every two are compared by one product of matrices
LONG = 1 << 14  # members of a list that one task compares
GROUP = 1 << 20  # values of a group's sets that one task compares
WHOLE = 1 << 30  # retained values of the exact option
CHANCE = 1e-9  # that two sets at the threshold share too few retained values
FINGER = 16  # bits of a value that travel with a list's entries, for sketches of up to FEW values; 32 for longer ones
FEW = 256
_U = np.uint64


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, of all words if it has fewer."""
    split = [t.lower().split() for t in texts]  # bytes: A-Z only, and the six ASCII blanks
    data = b"".join([b" ".join(w) + b" " for w in split if w])
    size = np.array([len(w) for w in split], np.int64)
    if not data:
        return [np.zeros(0, _U)] * len(texts)
    h = word_hashes(data, np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1]))
    ends = np.cumsum(size)
    out = np.full(len(h), n, _U)
    for j in range(n):
        ahead = np.zeros(len(h), _U)
        ahead[: len(h) - j] = h[j:]
        out = mixed(out * _U(0x9E3779B97F4A7C15) + ahead)
    found = []
    for a, b in zip((ends - size).tolist(), ends.tolist()):
        if 0 < b - a < n:
            found.append(_fold(h[a:b]))
        else:
            found.append(np.unique(out[a : max(a, b - n + 1)]))
    return found


def _fold(h: np.ndarray) -> np.ndarray:
    """A short text's whole sequence, unlike a shingle of another length."""
    out = np.array([len(h)], _U)
    for x in h:
        out = mixed(out * _U(0x9E3779B97F4A7C15) + x)
    return out


def likely_common(g: int, t: float) -> int:
    """Values of a sample of `g` from the union that lie in both sets, but for CHANCE, at similarity `t`."""
    if g >= WHOLE:
        return 0
    tail = 0.0
    for c in range(g + 1):
        tail += math.comb(g, c) * t**c * (1 - t) ** (g - c)
        if tail > CHANCE:
            return max(1, c)
    return g


def shared(size: Column, g: int, t: float) -> Column:
    """Retained values that a set of this size shares at least with a similar one. While `g` exceeds what lies outside
    the intersection, that is a certain bound; sets within `t * g` are whole in both sketches."""
    whole = F.ceil(F.round(size * t, 9))
    sure = F.least(whole, F.lit(g) - F.floor(F.round(size * ((1 - t) / t), 9)))
    return F.when(size <= t * g, whole).otherwise(F.greatest(F.lit(likely_common(g, t)), sure)).cast("int")


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sets of the texts, about a million bytes of them at a time."""
    for a, b in in_groups(texts):
        yield from shingles(texts[a:b], n)


def described(docs: DataFrame, n: int, k: int) -> DataFrame:
    """doc_id, row (its `row_key`), n_shingles, key (of the set), sketch for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, sketch = [], [], []
            for s in _sets([t or b"" for t in batch.column(2).to_pylist()], n):
                size.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(s[:k].view(np.int64))
            flat = np.concatenate(sketch) if sketch else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "row", "n_shingles", "key", "sketch"])
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select(docs["doc_id"].alias("doc_id"), row_key(docs).alias("row"), docs["text"].cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, row struct<x: bigint, y: bigint>, n_shingles long, key binary, sketch array<bigint>")


def near(rows: DataFrame) -> DataFrame:
    """A written table, for a join: broadcast while it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


def connected(classes: DataFrame, k: int, t: float) -> DataFrame:
    """The classes that share enough retained values with others; the rest has no link. Only their numbers are written
    and dealt, never the sketches."""
    left = classes
    for _ in range(PRUNED):
        values = left.select("cid", F.explode("sketch").alias("v"))
        alone = values.groupBy("v").agg(F.count("*").alias("df"), F.min("cid").alias("cid")).where("df = 1").groupBy("cid").agg(F.count("*").alias("own"))
        spare = left.select("cid", (F.size("sketch") - shared(F.col("n_shingles"), k, t)).alias("spare"))
        left = classes.join(near(cut(spare.join(alone, "cid", "left").where(F.coalesce("own", F.lit(0)) <= F.col("spare")).select("cid"))), "cid")
    return left


def lists(classes: DataFrame, g: int, t: float) -> DataFrame:
    """v, cid: each class with those of its rarest values among the `g` smallest that another class has too."""
    values = classes.select("cid", F.explode(F.slice("sketch", 1, g)).alias("v"))
    often = cut(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    ranked = values.join(near(often), "v").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("ranked"))
    # The values that only this class has are the rarest; what is left of the prefix are the first of the others.
    take = F.greatest(F.size("ranked") - F.col("few") + 1, F.lit(0))
    own = classes.select("cid", shared(F.col("n_shingles"), g, t).alias("few"))
    return ranked.join(own, "cid").select("cid", F.explode(F.slice("ranked.v", 1, take)).alias("v"))


def _estimate(k: int, t: float):
    """Keeps the pairs whose sketches do not exclude the similarity: the union's k smallest values are a sample of
    the union, and those in both sketches a sample of the intersection. Only the order of the values in a sketch counts:
    before a common value lie in the union those before it in either sketch, the common ones once."""
    least = likely_common(k, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column("sketch_a"), batch.column("sketch_b")))
            keep = []
            for i in range(batch.num_rows):
                a, b = da[oa[i] : oa[i + 1]], db[ob[i] : ob[i + 1]]
                both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                if max(len(a), len(b)) < k:  # whole sets
                    keep.append(len(both) >= round(t * (len(a) + len(b) - len(both)), 9))
                else:
                    by = np.argsort(at_a)
                    keep.append(np.count_nonzero(at_a[by] + at_b[by] - np.arange(len(both)) < k) >= least)
            yield batch.select(["a", "b", "long"]).filter(pa.array(keep, pa.bool_()))
        released()

    return run


def _loose(a: np.ndarray, b: np.ndarray, k: int, t: float) -> bool:
    """The same for sketches in which values look equal: those may hide as many common ones."""
    own_a, own_b = np.unique(a), np.unique(b)
    most = len(np.intersect1d(own_a, own_b, assume_unique=True)) + min(len(a) - len(own_a), len(b) - len(own_b))
    if max(len(a), len(b)) < k:
        return most >= round(t * (len(a) + len(b) - most), 9)
    return most >= likely_common(k, t)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        body = [zip_.compress(t or b"") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.binary())], ["cid", "groups", "body"])


def _whole_keys(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.RecordBatch | pa.Table]:
    """The rows of sorted batches in tables that end where the first column changes; of about `most` rows, more only
    where one key has them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if rows < most or key[0] == key[-1]:
            if len(held) == 1 or rows < most or held[-2].column(0)[-1].as_py() == key[0]:
                continue
            last = 0
        else:
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)]).combine_chunks()
        held = [batch.slice(last)]
        rows = batch.num_rows - last
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _stretches(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    return at[:-1], at[1:]


def _sharing(n: np.ndarray, least: np.ndarray, values: np.ndarray, ends: np.ndarray, t: float) -> np.ndarray:
    """For each two members of a list whether they share enough retained values and their sizes allow the similarity."""
    m = len(n)
    flat, count = np.unique(values, return_inverse=True, return_counts=True)[1:]
    own = count[flat] > 1  # values of two members or more
    row, col = np.repeat(np.arange(m), np.diff(ends))[own], (np.cumsum(count > 1) - 1)[flat[own]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    both = np.zeros((m, m), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [c, c + 4096])
        has = np.zeros((m, min(4096, int(col[-1]) + 1 - c)), np.float32)
        has[row[a:b], col[a:b] - c] = 1
        both += has @ has.T
    small, large = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    return (both >= np.maximum(least[:, None], least)) & (small >= np.round(t * large, 9))


def _reached(n: np.ndarray, least: np.ndarray, tied: np.ndarray, values: np.ndarray, ends: np.ndarray, k: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The edges (places) that `trees` finds in one list, for long ones: a member's values lead to those it shares them
    with, so no two members without a further common value are looked at, and what an edge has reached is left out."""
    m, size = len(n), np.diff(ends).astype(np.int64)
    flat = np.unique(values, return_inverse=True)[1].astype(np.int64)
    row = np.repeat(np.arange(m), size)
    first = np.unique(flat * m + row, return_index=True)[1]  # by value; a value that a sketch seems to have twice once
    flat_of, row_of, place_of = flat[first], row[first], (np.arange(len(flat)) - ends[row])[first]
    by = np.argsort(row_of, kind="stable")
    own_flat, own_place, own_ends = flat_of[by], place_of[by], np.concatenate([[0], np.cumsum(np.bincount(row_of, minlength=m))])
    hidden = size - np.diff(own_ends)
    n_values = int(flat.max(initial=-1)) + 1
    begin = np.concatenate([[0], np.cumsum(np.bincount(flat_of, minlength=n_values))])
    chance = likely_common(k, t)

    def alike(i: int) -> np.ndarray:
        f, p = (x[own_ends[i] : own_ends[i + 1]] for x in (own_flat, own_place))
        count = begin[f + 1] - begin[f]
        at = np.arange(int(count.sum())) + np.repeat(begin[f] - np.cumsum(count) + count, count)
        who = row_of[at]
        both = np.bincount(who, minlength=m)
        j = np.flatnonzero(new & (both >= np.maximum(least, least[i])))
        j = j[np.minimum(n[j], n[i]) >= np.round(t * np.maximum(n[j], n[i]), 9)]
        if not len(j):
            return j
        loose = tied[j] | tied[i]
        most = both[j] + np.where(loose, np.minimum(hidden[j], hidden[i]), 0)
        whole = np.maximum(size[j], size[i]) < k
        ok = np.where(whole, most >= np.round(t * (size[j] + size[i] - most), 9), most >= chance)
        asked = j[ok & ~whole & ~loose]
        if len(asked):
            mark = np.zeros(m, bool)
            mark[asked] = True
            has = mark[who]
            w, a, b = who[has], np.repeat(p, count)[has], place_of[at[has]]
            by = np.lexsort((a, w))
            w, reach = w[by], (a + b)[by]
            start, end = _stretches(w)
            rank = np.arange(len(w)) - np.repeat(start, end - start)
            inside = np.bincount(w[reach - rank < k], minlength=m)
            ok &= whole | loose | (inside[j] >= chance)
        return j[ok]

    new, left, right = np.ones(m, bool), [], []
    held = m
    for lead in range(m):
        todo = [lead] if new[lead] else []
        new[todo] = False
        while todo:
            rest = int(np.count_nonzero(new))
            if not rest:
                break
            if 2 * rest < held:  # only values of those that are left are kept
                keep, held = new[row_of], rest
                flat_of, row_of, place_of = flat_of[keep], row_of[keep], place_of[keep]
                begin = np.concatenate([[0], np.cumsum(np.bincount(flat_of, minlength=n_values))])
            i = todo.pop()
            j = alike(i)
            new[j] = False
            todo += j.tolist()
            left.append(np.full(len(j), i))
            right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def trees(k: int, t: float):
    """Edges (a, b) that join what is alike in each list; the lists (v, cid, n, least, tied, sk) come one after the
    other. `tied` are sketches in which values look equal, since only some of their bits are here."""
    estimate = _estimate(k, t)

    def alike(cid: np.ndarray, tied: np.ndarray, sketches: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of places pass the estimate."""
        ok = tied[i] | tied[j]
        at = np.flatnonzero(~ok)
        for p in np.flatnonzero(ok).tolist():
            a, b = (sketches[int(q[p])].values.to_numpy(zero_copy_only=False) for q in (i, j))
            ok[p] = _loose(a, b, k, t)
        if len(at):
            pairs = [pa.array(at), pa.array(cid[j[at]]), pa.array(np.zeros(len(at), bool)), sketches.take(pa.array(i[at])), sketches.take(pa.array(j[at]))]
            for out in estimate([pa.RecordBatch.from_arrays(pairs, ["a", "b", "long", "sketch_a", "sketch_b"])]):
                ok[out.column(0).to_numpy()] = True
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            v, cid, n, least, tied = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in range(5))
            sk = pa.concat_arrays(table.column(5).chunks)
            offsets = sk.offsets.to_numpy()
            parts, sketches = sk.values.to_numpy(zero_copy_only=False), sk
            left, right = [], []
            first, last = _stretches(v)
            two = np.flatnonzero(last - first == 2)  # most lists, all at once
            if len(two):
                i, j = first[two], first[two] + 1
                fits = np.minimum(n[i], n[j]) >= np.round(t * np.maximum(n[i], n[j]), 9)
                i, j = i[fits], j[fits]
                pairs = np.unique(np.stack([cid[i], cid[j]]), axis=1, return_index=True)[1]  # once each
                i, j = i[pairs], j[pairs]
                ok = alike(cid, tied, sketches, i, j)
                left.append(i[ok])
                right.append(j[ok])
            for x, y in zip(first.tolist(), last.tolist()):
                if y - x < 3:
                    continue
                if y - x > FULL:
                    i, j = _reached(n[x:y], least[x:y], tied[x:y], parts[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], k, t)
                    left.append(x + i)
                    right.append(x + j)
                    continue
                may = _sharing(n[x:y], least[x:y], parts[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], t)
                new = np.ones(y - x, bool)
                while new.any():
                    todo = [int(np.argmax(new))]
                    new[todo[0]] = False
                    while todo:
                        i = todo.pop()
                        j = np.flatnonzero(may[i] & new)
                        if len(j):
                            j = j[alike(cid, tied, sketches, np.full(len(j), x + i), x + j)]
                            new[j] = False
                            todo += j.tolist()
                            left.append(np.full(len(j), x + i))
                            right.append(x + j)
            if left:
                a, b = cid[np.concatenate(left)], cid[np.concatenate(right)]
                ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])
        released()

    return run


def together(sets: list[np.ndarray], t: float) -> np.ndarray:
    """For each of the sets a number that it shares with the sets it is linked with, over others or directly."""
    m, percent = len(sets), round(t * 1_000_000)
    label, size = np.arange(m), np.array([len(s) for s in sets], np.int64)
    flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    who = np.repeat(np.arange(m), size)
    often = count[flat] > 1  # values that only one set has are never common
    weight = np.bincount(who, count[flat], m)
    flat, who = flat[often], who[often]
    shares = np.bincount(who, minlength=m)
    ends = np.concatenate([[0], np.cumsum(shares)])
    mark = np.zeros(len(count), bool)

    def common(i: int, rows: np.ndarray) -> np.ndarray:
        mark[flat[ends[i] : ends[i + 1]]] = True
        if 4 * len(rows) > m:
            both = np.bincount(who[mark[flat]], minlength=m)[rows]
        else:
            both = np.array([np.count_nonzero(mark[flat[ends[j] : ends[j + 1]]]) for j in rows.tolist()], np.int64)
        mark[flat[ends[i] : ends[i + 1]]] = False
        return both

    def enough(both: np.ndarray, i: int, rows: np.ndarray) -> np.ndarray:
        return (1_000_000 + percent) * both >= percent * (size[i] + size[rows])

    every = np.arange(m)
    lead = int(np.argmax(weight))
    inside = common(lead, every)
    label[enough(inside, lead, every)] = lead
    outside = shares - inside
    for i in np.flatnonzero(label != lead).tolist():
        if label[i] == label[lead]:
            continue  # a set that is not with the leader is compared with this one in its own turn
        most = np.minimum(inside, inside[i]) + np.minimum(outside, outside[i])
        rows = np.flatnonzero((label != label[i]) & enough(most, i, every))
        if len(rows):
            rows = rows[enough(common(i, rows), i, rows)]
            if len(rows):
                label[np.isin(label, label[rows])] = label[i]
    return label


def _linked(n: int, t: float):
    """Edges (a, b) over each component of links in the groups (place, cid, body), which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for table in _whole_keys(batches, 256):
            group, cid = (table.column(c).combine_chunks().to_numpy() for c in (0, 1))
            bodies, left, right = table.column(2), [], []
            for x, y in zip(*(e.tolist() for e in _stretches(group))):
                own, at = np.unique(cid[x:y], return_index=True)  # rows that are equal in id and text come twice
                if len(own) < 2:
                    continue
                label = together(list(_sets([unzip.decompress(bodies[x + i].as_py()) for i in at.tolist()], n)), t)
                first = own[np.unique(label, return_index=True)[1]][np.unique(label, return_inverse=True)[1]]
                left.append(first[own != first])
                right.append(own[own != first])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
        released()

    return run


def components(links: DataFrame) -> DataFrame:
    """key, label: the smallest key reachable over the links (a, b). In each round every node goes to its smallest
    neighbour, the links follow, and links within a node fall away; only written tables are kept, never a collected
    list, and their sizes are known, so plans stay small however many rounds it takes."""
    ends = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).distinct()
    labels = cut(ends.select("key", F.col("key").alias("label")))
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = near(cut(both.where("b < a").groupBy("a").agg(F.min("b").alias("to"))))
        move = lambda df, c: df.join(step.select(F.col("a").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: E731, B023
        labels = cut(move(labels, "label"))
        edges = cut(move(move(edges, "a"), "b").where("a <> b").distinct())
    return labels


def places(whole: str, alone: Column, member: str) -> Column:
    """Where a member of `whole` is compared: `alone`, or, if `parts` is not null, each two of so many blocks, the lower
    first, of which its own is one."""
    block = F.pmod(F.xxhash64(member), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != block)
    both = F.transform(others, lambda x: F.xxhash64(whole, F.least(x, block), F.greatest(x, block)))
    return F.when(F.col("parts").isNull(), F.array(alone)).otherwise(both)


def candidates(classes: DataFrame, k: int, g: int, t: float) -> DataFrame:
    """a, b: edges that join all classes with links between them, and some others."""
    left = connected(classes, k, t)
    entries = cut(lists(left, g, t))
    length = cut(entries.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"))
    # Values of a set that look equal take from what it shares.
    bits, kind = (FINGER, "smallint") if k <= FEW else (32, "int")
    part = F.transform("sketch", lambda x: F.shiftright(F.shiftleft(x, 64 - bits), 64 - bits).cast(kind))
    lost = F.size("sketch") - F.size(F.array_distinct(part))
    own = left.select("cid", F.col("n_shingles").alias("n"), F.greatest(shared(F.col("n_shingles"), k, t) - lost, F.lit(1)).alias("least"), (lost > 0).alias("tied"), part.alias("sk"))
    placed = entries.join(near(length), "v").withColumn("parts", F.when(F.col("m") > LONG, F.ceil(F.col("m") * 2 / LONG).cast("int")))
    placed = placed.select("cid", F.explode(places("v", F.col("v"), "cid")).alias("v"))
    dealt = placed.join(own, "cid").select("v", "cid", "n", "least", "tied", "sk")
    return cut(dealt.repartition("v").sortWithinPartitions("v").mapInArrow(trees(k, t), "a long, b long").distinct())


def links(docs: DataFrame, classes: DataFrame, edges: DataFrame, n: int, t: float) -> DataFrame:
    """a, b: edges over each component of links within the groups that the candidates join."""
    grouped = cut(components(edges).join(classes.select(F.col("cid").alias("key"), "n_shingles", F.col("first.row").alias("_row")), "key"))
    # Blocks of half of what a task compares.
    parts = grouped.groupBy("label").agg(F.sum("n_shingles").alias("values")).where(F.col("values") > GROUP).select("label", F.ceil(F.col("values") * 2 / GROUP).cast("int").alias("parts"))
    rep = cut(grouped.join(near(cut(parts)), "label", "left").select(F.col("key").alias("cid"), "_row", places("label", F.xxhash64("label"), "key").alias("groups")))
    own = docs.select(row_key(docs).alias("_row"), docs["text"].cast("binary").alias("body"))
    bodies = own.join(near(rep), "_row").select("cid", "groups", "body").mapInArrow(_compressed, "cid long, groups array<bigint>, body binary")
    placed = bodies.select(F.explode("groups").alias("place"), "cid", "body")
    return cut(placed.repartition("place").sortWithinPartitions("place").mapInArrow(_linked(n, t), "a long, b long"))


def _placed(docs: DataFrame, n: int, t: float, k: int, exact: bool = False) -> DataFrame:
    """doc_id, row, n_shingles and least (the doc_id and row of its component's first row, null ids last) for every
    row of `docs`."""
    k, g = (WHOLE, WHOLE) if exact else (k, max(8, 3 * k // 8))
    small_batches(docs.sparkSession)
    spark, (wide, wider) = docs.sparkSession, (unique_path(docs.sparkSession, "sketches") for _ in range(2))
    rows = cut(described(docs, n, k), wide)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    made = rows.where("n_shingles > 0").groupBy("key").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    sketches = cut(made.withColumn("cid", F.monotonically_increasing_id()), wider)  # written at once, so that the numbers stay
    # The sketches of rows go once the classes have theirs, those of classes once the candidates are found.
    rows = cut(rows.drop("sketch"))
    drop(spark, wide)
    edges = candidates(sketches, k, g, t)
    classes = cut(sketches.drop("sketch"))
    drop(spark, wider)
    labels = components(links(docs, classes, edges, n, t))
    ids = classes.select("key", "cid", F.col("first").alias("least"))
    linked = labels.select(F.col("key").alias("cid"), "label").join(ids, "cid")
    smallest = linked.groupBy("label").agg(F.min("least").alias("first"))
    ids = ids.join(linked.join(smallest, "label").select("cid", "first"), "cid", "left").select("key", F.coalesce("first", "least").alias("least"))
    ids = cut(ids.select("key", "least"))
    return rows.select("doc_id", "row", "n_shingles", "key").join(ids, "key", "left").select("doc_id", "row", "n_shingles", "least")


def near_duplicates(docs: DataFrame, n: int = 5, t: float = 0.8, k: int = 64, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`."""
    own = F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return _placed(docs, n, t, k, exact).select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def dedup(docs: DataFrame, n: int = 5, t: float = 0.8, k: int = 64) -> DataFrame:
    """One row of each component, the one of the smallest id (null ids last), and all rows without a shingle; all
    columns stay. Every row is judged by its own text; of rows that are equal in id and text the smallest is kept."""
    verdict = cut(_placed(docs, n, t, k).where("n_shingles > 0").select("row", (F.col("row") == F.col("least.row")).alias("first")))
    gone = cut(verdict.where("not first").select("row").distinct())
    twice = cut(verdict.where("first").groupBy("row").count().where("count > 1").select("row"))
    near = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    if not twice.count():
        gone = near(gone)
        return docs.join(gone, row_key(docs) == gone["row"], "left_anti")
    out, again = near(gone.unionByName(twice)), near(twice)
    once = docs.join(again, row_key(docs) == again["row"], "left_semi").groupBy(row_key(docs)).agg(F.min(F.struct(*[docs[f"`{c}`"] for c in docs.columns])).alias("whole"))
    return docs.join(out, row_key(docs) == out["row"], "left_anti").unionByName(once.select("whole.*"))
