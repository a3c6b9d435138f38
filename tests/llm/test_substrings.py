import collections
import random
import sys
import tracemalloc

import numpy as np
import pytest

from keyloom.llm import routing, substring_fm, suffix_merge

BIG = 1 << 62


def brute_words(docs, k):
    split = [(d, (t or "").encode().split()) for d, t in docs]
    seen = collections.Counter(tuple(w[i : i + k]) for _, w in split for i in range(len(w) - k + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def brute_bytes(docs, k):
    texts = [(BIG if d is None else d, d, (t or "").encode()) for d, t in docs]
    first = {}
    for n, _, t in texts:
        for i in range(len(t) - k + 1):
            first[t[i : i + k]] = min(n, first.get(t[i : i + k], BIG))
    out = []
    for n, d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - k + 1):
            if first[t[i : i + k]] < n:
                gone[i : i + k] = [True] * k
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def got(df, *columns):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, sf):
    own = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    run = " ".join(["same"] * 90)
    return own + [(None, own[3][1]), (None, None), (7, ""), (7, own[5][1]), (None, own[3][1]), (2**60 + 1, run + own[9][1]), (2**60 + 2, run), (5, own[5][1]), (10**7, " \t\n"), (10**7 + 1, "日本語" * 60), (10**7 + 2, "x日本語" * 3 + "日本語" * 60)]


SMALL = dict(chunk_bytes=60_000, sub_bytes=10_000, frequent=3)


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_words(spark, docs, sizes):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, chunk int, kept int")
    assert got(substring_fm.dedup_words(df, **sizes), "doc_id", "n_words", "n_removed", "kept") == brute_words(docs, 35)


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_bytes(spark, docs, sizes):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, chunk int, kept int")
    assert got(suffix_merge.dedup_bytes(df, **sizes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == brute_bytes(docs, 50)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_fm.dedup_words(df).collect() == [] and suffix_merge.dedup_bytes(df).collect() == []


def test_indexes_against_brute_force(monkeypatch):
    rng = random.Random(3)
    for _ in range(150):
        k, letters = rng.choice([2, 3, 5, 8]), rng.choice([1, 2, 5, 30])
        base = [rng.randrange(letters) for _ in range(40)]
        made = {tuple([0] * k)}
        for _ in range(rng.randrange(1, 15)):
            a = rng.randrange(30)
            s = base[a : a + rng.randrange(k, k + 10)] + [rng.randrange(letters) for _ in range(rng.randrange(3))]
            if len(s) >= k:
                made.add(tuple(s))
        segments = rng.sample(sorted(made), len(made))
        places = np.array([rng.choice([1, 1, 1, 3]) for _ in segments])
        texts = [b" ".join(b"w%d" % x for x in s) for s in segments]
        seen = collections.Counter()
        for s, p in zip(segments, places):
            for i in range(len(s) - k + 1):
                seen[s[i : i + k]] += p
        expected = [int(seen[s[i : i + k]] >= 2) for s in segments for i in range(len(s) - k + 1)]
        assert substring_fm.repeated(texts, places, places, routing.Units(k, 1, True)).tolist() == expected
        monkeypatch.setattr(suffix_merge, "BLOCK", rng.choice([5, 30, 1000]))
        least = np.array([rng.randrange(50) for _ in segments])
        first = {}
        for s, n in zip(segments, least.tolist()):
            for i in range(len(s) - k + 1):
                first[s[i : i + k]] = min(n, first.get(s[i : i + k], BIG))
        expected = [first[s[i : i + k]] for s in segments for i in range(len(s) - k + 1)]
        assert suffix_merge.first_documents([bytes(s) for s in segments], least, least, routing.Units(k, 1, False)).tolist() == expected


@pytest.mark.parametrize("k", [35, 300, 400])
def test_long_windows(k):
    """The index tells strings apart that differ only far behind their begin."""
    rng = random.Random(k)
    base = [rng.randrange(3) for _ in range(3 * k)]
    segments = [tuple(base[a : a + k + 20]) for a in (0, 7, 40)] + [tuple(base[: k - 1] + [9] + base[k : k + 9])]
    texts = [b" ".join(b"w%d" % x for x in s) for s in segments]
    seen = collections.Counter(s[i : i + k] for s in segments for i in range(len(s) - k + 1))
    expected = [int(seen[s[i : i + k]] >= 2) for s in segments for i in range(len(s) - k + 1)]
    assert 0 < sum(expected) < len(expected)
    one = np.ones(len(texts), np.int64)
    assert substring_fm.repeated(texts, one, one, routing.Units(k, 1, True)).tolist() == expected


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 11, 300)
    m = substring_fm.WaveletMatrix(s, 10)
    for c in range(11):
        for p in (0, 1, 63, 64, 65, 299, 300):
            assert m.walk(np.array([c]), np.array([p]))[0] - m.walk(np.array([c]), np.array([0]))[0] == (s[:p] == c).sum()


def test_merge_gives_order_and_common_prefixes():
    rng = random.Random(2)
    texts = [np.array([rng.randrange(1, 3) for _ in range(n)] + [0], np.int64) for n in (30, 17, 44)]
    depth = 7
    place, prefix = suffix_merge.merge(texts, [suffix_merge.block_order(t, depth + 5) for t in texts], depth)
    rings = [(np.tile(t, 3), len(t)) for t in texts]
    keys = [tuple(r[i : i + depth]) for r, n in rings for i in range(n)]
    assert [keys[p] for p in place] == sorted(keys)
    assert [p == depth for p in prefix[1:]] == [keys[a] == keys[b] for a, b in zip(place, place[1:])]


@pytest.mark.parametrize("collide", [False, True])
def test_equal_pieces_are_found_by_their_bytes(monkeypatch, collide):
    if collide:
        monkeypatch.setattr(routing, "mixed", lambda h: h & np.uint64(1))
    monkeypatch.setattr(routing, "HEAD", 24)
    rng = random.Random(5)
    data = bytes(rng.randrange(2) * 255 for _ in range(300)) + b"ab" * 200
    first = np.array([rng.randrange(len(data) - 70) for _ in range(3000)] + [len(data)])
    size = np.array([rng.randrange(70) for _ in range(3000)] + [0])
    which, lead, h = routing._alike(data, first, size)
    content = [data[a : a + n] for a, n in zip(first.tolist(), size.tolist())]
    assert [content[i] for i in lead[which]] == content and len(lead) == len(set(content))
    turn = np.array(rng.sample(range(len(content)), len(content)))
    lead2, h2 = routing._alike(data, first[turn], size[turn])[1:]  # in an order that depends on the contents alone
    assert [content[i] for i in turn[lead2]] == [content[i] for i in lead] and h2.tolist() == h.tolist()


def test_segments_are_compared_without_a_step_of_python_for_each():
    """The work in Python is that of the arrays, not of their elements."""
    rng = random.Random(6)
    u = routing.Units(50, 16, False)
    for texts in ([bytes(rng.randrange(97, 123) for _ in range(100_000))] * 2, [b"abcdefg " * 5000]):
        s = routing.segments(texts, u)
        flags = {int(b): bytes([1 + (len(texts) == 1)]) * int(n) for b, n in zip(*np.unique(routing._buckets(s.anchor, 4)[0], return_counts=True))}
        steps = 0

        def count(frame, event, arg):
            nonlocal steps
            steps += 1

        sys.setprofile(count)
        c = routing._candidates(s, u, 4, flags)
        sys.setprofile(None)
        assert len(c.place) > 10_000 and steps < 2000


def test_merge_takes_as_many_symbols_a_round_as_a_number_holds(monkeypatch):
    rng = random.Random(7)
    texts = [bytes(rng.randrange(1, 101) for _ in range(3000)) for _ in range(40)]
    rounds, own_places = [], suffix_merge._own_places
    monkeypatch.setattr(suffix_merge, "_own_places", lambda *a: rounds.append(1) or own_places(*a))
    monkeypatch.setattr(suffix_merge, "BLOCK", 60_000)
    ids = np.arange(len(texts))
    assert suffix_merge.first_documents(texts, ids, ids, routing.Units(50, 16, False)).tolist() == np.repeat(ids, 2951).tolist()
    assert len(rounds) <= 7  # 101 symbols of 7 bits: nine a round, and once for the result


@pytest.mark.parametrize("letters", [1, 2, 60, 256])
def test_first_documents_over_alphabets(monkeypatch, letters):
    rng = random.Random(letters)
    base = bytes(rng.randrange(256 - letters, 256) for _ in range(700))
    texts = sorted({base[a : a + 50 + rng.randrange(30)] for a in (rng.randrange(600) for _ in range(80))})
    least = np.array([rng.randrange(50) for _ in texts])
    first = {}
    for t, n in zip(texts, least.tolist()):
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(n, first.get(t[i : i + 50], BIG))
    expected = [first[t[i : i + 50]] for t in texts for i in range(len(t) - 49)]
    for block in (300, 1500, 1 << 19):
        monkeypatch.setattr(suffix_merge, "BLOCK", block)
        assert suffix_merge.first_documents(texts, least, least, routing.Units(50, 16, False)).tolist() == expected


def test_long_pieces_are_not_held_all_at_once():
    data, n = random.Random(8).randbytes(2000) * 60, 100_000
    tracemalloc.start()
    lead = routing._alike(data, np.arange(n), np.full(n, 300))[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lead) == 2000 and peak < 300 * n
