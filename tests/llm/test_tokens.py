import random
import zlib

import numpy as np
import pytest

from keyloom.llm import encoding, token_counts, token_files
from keyloom.llm.queries import vocabulary

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "'s", "<|endoftext|>", ".", "!!", " ", " ", "日本", "x" * 9, "\x1c", " "]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(1)
    own = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    return own + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(600)] + ["", " ", "a ", " a", "\n"]


@pytest.fixture(scope="module")
def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(vocabulary()).encode_batch(texts, add_special_tokens=False)]


def test_equal_hashes_are_told_apart(texts, whole, monkeypatch):
    """Pieces are compared by their bytes: hashes that hardly differ change nothing."""
    kept = encoding.piece_hashes
    monkeypatch.setattr(encoding, "piece_hashes", lambda *a: kept(*a) % np.uint64(50))
    enc = encoding.Encoder(vocabulary())
    assert [list(g) for _ in range(2) for g in enc.ids(texts[:80])] == whole[:80] * 2


def test_pieces_give_the_librarys_ids(texts, whole):
    enc = encoding.Encoder(vocabulary(), max_pieces=500)
    got = [ids for a, b in encoding.in_groups(texts, 20_000) for ids in enc.ids(texts[a:b])]
    assert [list(g) for g in got] == whole
    assert np.concatenate([enc.counts(texts[a:b]) for a, b in encoding.in_groups(texts, 20_000)]).tolist() == [len(w) for w in whole]


@pytest.mark.parametrize("chunk, overlap", [(7, 2), (40, 8), (500, 30)])
def test_resynchronisation(texts, whole, chunk, overlap):
    enc = encoding.Encoder(vocabulary())
    for t, w in list(zip(texts, whole))[40:]:
        if len(t) > chunk:
            assert token_counts.resync_count(enc, t, chunk, overlap) == len(w), t
    own = [(t, len(w)) for t, w in zip(texts, whole)]
    assert token_counts.spliced_counts(enc, [t for t, _ in own], chunk, overlap) == [n for _, n in own]


def test_how_many_are_spliced(spark, sf, monkeypatch):
    """With the defaults a good part of the given documents' characters goes through chunks, most at the first overlap."""
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    huge = [t for t in texts if len(t) > 8192]
    alone = []
    kept = token_counts.resync_count
    monkeypatch.setattr(token_counts, "resync_count", lambda enc, t, *a: (alone.append(t), kept(enc, t, *a))[1])
    enc = encoding.Encoder(vocabulary())
    assert len(huge) >= 3 and token_counts.spliced_counts(enc, huge, 4096, 96) == enc.counts(huge).tolist()
    assert len(alone) <= len(huge) // 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_are_encoded_whole(name):
    enc = encoding.Encoder(vocabulary(name))
    assert not enc.by_piece and enc.counts(["", "two words"]).tolist()[0] == 0


@pytest.mark.parametrize("limit", [20, 13])
def test_codes(whole, limit):
    ids = np.concatenate([np.array(w, np.int64) for w in whole if w])
    counts = np.bincount(ids)
    lengths = token_files.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() == 1
    code, table = token_files.codes(lengths), token_files.tables(lengths)
    for n in (0, 1, 2, 255, 256, 257, 5000):
        bits, offsets = token_files.pack(ids[:n], lengths, code)
        assert (token_files.unpack(bits, offsets, n, table) == ids[:n]).all()


def test_one_id():
    lengths = token_files.code_lengths(np.array([0, 0, 5]))
    bits, offsets = token_files.pack(np.array([2, 2, 2]), lengths, token_files.codes(lengths))
    assert token_files.unpack(bits, offsets, 3, token_files.tables(lengths)).tolist() == [2, 2, 2]


def test_optimal_without_a_limit():
    import heapq

    rng = random.Random(4)
    counts = np.array([rng.randrange(1, 1000) for _ in range(200)])
    heap = counts.tolist()
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        cost += (x := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, x)
    assert (token_files.code_lengths(counts, 40).astype(int) * counts).sum() == cost


@pytest.fixture(scope="module")
def rows(texts):
    return [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "x"), (3, "again"), (3, "again"), (10**15, "last " * 3000)]


def test_counts(spark, rows, whole):
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(df, vocabulary(), huge=2000, chunk=900, overlap=16).collect()
    expected = {i: len(w) for i, w in enumerate(whole)}
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] not in (None, 3, 10**15)} == {i: n for i, n in expected.items() if i != 3}
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert sorted(r["n_bytes"] for r in got if r["doc_id"] is None) == [0, 1]
    assert token_counts.count_tokens(df.limit(0), vocabulary()).collect() == []


def test_files(spark, rows, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 3000)
    monkeypatch.setattr(token_files, "PART_IDS", 10_000)
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(vocabulary()).encode
    own = [(d, np.array([*encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in rows]
    own = sorted(((d, zlib.crc32(x), x) for d, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, start = [], 0
    for d, crc, x in own:
        expected.append((d, start, len(x) // 4, crc, x))
        start += len(x) // 4
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, part string")
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in token_files.round_trip(df, vocabulary()).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    assert token_files.round_trip(df.limit(0), vocabulary()).collect() == []
