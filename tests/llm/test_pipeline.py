import zlib

import numpy as np

import corpus_pipeline
from keyloom.llm import decontaminate, toxicity
from keyloom.llm.queries import vocabulary
from llm_brute import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frames[-1], sf).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
        assert frames[-1].columns == docs.columns
    toxic, near, clean, mixed = frames[1:]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(toxic) == ids(toxicity.score(docs, model).where("predicted = 0"))
    assert ids(near) == sorted(d for d, _, _, kept in brute([(r["doc_id"], r["text"]) for r in toxic.collect()], 5) if kept)
    bad = set(ids(decontaminate.contaminated(near, spark.read.parquet(f"{sf}/benchmark.parquet"))))
    assert ids(clean) == [d for d in ids(near) if d not in bad]
    assert set(ids(mixed)) <= set(ids(clean)) and max(ids(mixed).count(d) for d in set(ids(mixed))) <= 3
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(vocabulary()).encode
    start, expected = 0, []
    for d, t in sorted((r["doc_id"], r["text"]) for r in mixed.collect()):
        raw = np.array([*encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        expected.append((d, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    got = sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, mixed, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected


def test_odd_rows(spark, sf):
    """Nulls in any column, blank and repeated texts, a very long one, and columns with the stages' own names."""
    long, copied = " ".join(f"w{i % 977}" for i in range(60_000)), " ".join(f"c{i}" for i in range(40))
    rows = [(None, None), (1, ""), (2, " \n\t"), (None, copied), (3, copied), (4, copied), (4, copied), (5, long), (6, None), (7, "one"), (8, "ein kurzer Text")]
    docs = spark.createDataFrame([(d, t, None, s, None, "x", "y", 1, "z") for (d, t), s in zip(rows, ["a", None, "b"] * 4)], "doc_id long, text string, lang string, source string, n_chars long, row string, key string, label int, first string")
    kept, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
        seen.append([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted(seen[0], key=repr) == sorted(rows, key=repr)
    assert sum(t == copied for _, t in seen[1]) == 1 and len(seen[1]) == len(rows) - 3
    assert sorted(seen[2], key=repr) == sorted(seen[1], key=repr)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert len(out) == len(seen[3])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.collect() == []
