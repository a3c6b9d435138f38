import random
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import near_dedup
from llm_brute import brute


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(12)]
    made = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1 + len(w) // 12)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        made.append((i, " ".join(w)))
    return made + [(None, made[3][1]), (None, None), (7000, ""), (7001, "one"), (7002, "ONE"), (7003, None), (7, made[5][1]), (None, "zz top qq"), (7004, "É é"), (7005, "é É")]


@pytest.mark.parametrize("n", [2, 5])
def test_components(spark, rows, n):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, label int")
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(df, n).collect()), key=repr) == brute(rows, n)


def test_dedup_keeps_one_of_each(spark, rows):
    own = [r for r in rows if r[0] is not None and r[0] != 7]
    df = spark.createDataFrame([(d, t, "x") for d, t in own], "doc_id long, text string, gone_id string")
    left = near_dedup.dedup(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _, _, kept in brute(own, 5) if kept)


def test_dedup_judges_rows_of_one_id_by_themselves(spark):
    """A shared id, equal rows and null ids: one row of each group stays, and what has no copy is never lost."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "p"), (7, a, "q"), (7, b, "q"), (8, c, "s"), (8, c, "r"), (8, c + ".", "t"), (None, a, "u"), (None, "zz top qq", "w"), (None, "zz top qq", "v"), (None, None, "x"), (None, "", "y"), (9, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    left = near_dedup.dedup(df)
    assert left.columns == df.columns
    got = sorted((tuple(r) for r in left.collect()), key=repr)
    eights = [r for r in got if r[0] == 8]
    assert len(eights) == 1 and eights[0] in [(8, c, "r"), (8, c + ".", "t")]
    assert [r for r in got if r[0] != 8] == sorted([(1, a, "p"), (7, b, "q"), (None, "zz top qq", "v"), (None, None, "x"), (None, "", "y"), (9, "", "z")], key=repr)


def test_estimate_keeps_what_chance_allows():
    """The sample may hold `likely_common` values of 64 for a similarity of 0.8, and not one less."""
    least = near_dedup.likely_common(64, 0.8)
    made = lambda common: [np.sort(np.r_[np.arange(common), np.arange(100 + x, 300, 2)])[:64].astype(np.int64) for x in (0, 1)]
    a, b = zip(made(least), made(least - 1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array([True, False]), pa.array(a), pa.array(b)], ["a", "b", "long", "sketch_a", "sketch_b"])
    assert [x for out in near_dedup._estimate(64, 0.8)([batch]) for x in out.column(0).to_pylist()] == [1]


def test_bound_of_retained_values():
    """No two sets at the threshold share fewer retained values than `shared` says, where it is not left to chance."""
    assert near_dedup.likely_common(24, 0.8) == 6
    assert sum(comb(24, c) * 0.8**c * 0.2 ** (24 - c) for c in range(6)) < 1e-9


def test_long_lists_of_edited_copies(spark):
    """Lists of several hundred copies of one text, many too far from each other, and of unlike texts with a common
    passage: what leaders leave open is found as by comparing every pair, with sketches and with whole sets."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        if i % 5 == 0:
            del w[rng.randrange(40) :][: rng.randrange(8)]
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:12] + [f"u{rng.randrange(200)}" for _ in range(8)])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 2)
    for options in ({}, {"exact": True}):
        assert sorted((tuple(r) for r in near_dedup.near_duplicates(df, 2, **options).collect()), key=repr) == expected


def test_lists_give_trees_not_pairs():
    """A list of m members that are all alike gives m - 1 edges, however its rows are cut into batches."""
    m, sk = 300, list(range(64))
    rows = [(v, cid) for v in (5, 6) for cid in range(v, v + m)] + [(7, 900), (7, 901)]
    cols = [pa.array([v for v, _ in rows]), pa.array([c for _, c in rows]), pa.array([100] * len(rows)), pa.array([30] * len(rows), pa.int32()), pa.array([False] * len(rows)), pa.array([sk] * len(rows), pa.list_(pa.int32()))]
    whole = pa.RecordBatch.from_arrays(cols, ["v", "cid", "n", "least", "tied", "sk"])
    for step in (7, 1000):
        parts = [whole.slice(i, step) for i in range(0, len(rows), step)]
        assert sum(out.num_rows for out in near_dedup.trees(64, 0.8)(iter(parts))) == 2 * (m - 1) + 1


def test_long_lists_and_large_groups(spark, monkeypatch):
    """Lists over LONG and groups over GROUP, cut into blocks, give the links that comparing every pair gives."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 2, 4, 6, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**4)}"
        rows.append((i, " ".join(w)))
    expected = brute(rows, 2)
    assert len({c for _, _, c, _ in expected}) > 5
    monkeypatch.setattr(near_dedup, "LONG", 20)
    monkeypatch.setattr(near_dedup, "GROUP", 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(df, 2).collect()), key=repr) == expected


def test_long_lists_of_unlike_documents_join_nothing(spark, monkeypatch):
    """Values that more documents than LONG have, none of them alike, give no candidates and so no group of texts."""
    rng = random.Random(9)
    common = [f"c{i} d{i}" for i in range(30)]
    rows = [(i, " ".join(x for c in rng.sample(common, 20) for x in (c, f"u{rng.randrange(40)}"))) for i in range(120)]
    monkeypatch.setattr(near_dedup, "LONG", 20)
    found = []
    kept = near_dedup.links
    monkeypatch.setattr(near_dedup, "links", lambda docs, classes, edges, n, t: found.append(edges.count()) or kept(docs, classes, edges, n, t))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2)
    assert found == [0]


@pytest.mark.parametrize("size", [20, 40, 90])
def test_edges_of_long_lists_join_what_matrices_join(monkeypatch, size):
    """Counting along values finds the components that comparing every two members finds, with values that look equal."""
    rng = np.random.default_rng(size)
    m = 150
    rows = []
    for i in range(m):
        base = np.arange(64) * 500 + (i % 5)
        base[rng.choice(64, rng.integers(0, 22), replace=False)] += rng.integers(5, 400)
        rows.append(np.unique(base)[: min(64, size - i % 3)])
    sk = [np.where(np.arange(len(r)) == 3, r[2], r) if i % 7 == 0 else r for i, r in enumerate(rows)]
    cols = [pa.array([5] * m), pa.array(range(m)), pa.array([max(size, len(r)) for r in rows]), pa.array([12] * m, pa.int32()), pa.array([i % 7 == 0 for i in range(m)]), pa.array([x.tolist() for x in sk], pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(cols, ["v", "cid", "n", "least", "tied", "sk"])
    found = []
    for full in (m, 2):
        monkeypatch.setattr(near_dedup, "FULL", full)
        label = list(range(m))
        for out in near_dedup.trees(64, 0.8)(iter([batch])):
            for a, b in zip(*(c.to_pylist() for c in out.columns)):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        found.append(label)
    assert found[0] == found[1]
    assert 1 < len(set(found[0])) < m


def test_together_finds_every_link():
    rng = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(60, 101), replace=False), rng.integers(100, 130, rng.integers(0, 12)).astype(np.uint64)]) for _ in range(120)]
    label = near_dedup.together(sets, 0.8)
    found = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 10 * both >= 8 * (len(a) + len(b) - both):
                found[found == found[i]] = found[j]
    assert len(set(found.tolist())) > 3
    assert ((label[:, None] == label) == (found[:, None] == found)).all()


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(90, 90)], "a long, b long")
    got = {r["key"]: r["label"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 90: 90}


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
