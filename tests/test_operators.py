import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions.reducers import custom
from keyloom.operators import edges as E
from keyloom.operators import ordered as O
from keyloom.operators import reduce as R
from keyloom.operators import sequences as S
from keyloom.plans import vertex as V
from keyloom.sources import readers, sinks
from keyloom.streaming import updates

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
pairs = st.lists(st.tuples(st.integers(0, 9), st.integers(-100, 100)), max_size=40)


def kv(spark, rows):
    return spark.createDataFrame(rows, "key long, value long")


def got(df):
    return [tuple(r) for r in df.collect()]


@few
@given(a=pairs, b=pairs, parts=st.integers(1, 5))
def test_reduce_properties(spark, a, b, parts):
    expected = {}
    for k, v in a + b:
        expected[k] = expected.get(k, 0) + v
    whole = got(R.reduce_by_key(kv(spark, a + b).repartition(parts), "key", "value", "sum"))
    assert whole == sorted(expected.items())  # keys unique and ascending, sums kept, any partition count
    halves = R.union_all([R.reduce_by_key(kv(spark, x), "key", "value", "sum", ordered=False) for x in (a, b)])
    assert got(R.reduce_by_key(halves, "key", "value", "sum", one_shuffle=True)) == whole


def test_reduce_contract(spark):
    assert got(R.reduce_by_key(kv(spark, []), "key", "value", "sum")) == []
    assert got(R.reduce_by_key(kv(spark, [(None, 1), (2, None), (3, 4)]), "key", "value", "sum")) == [(3, 4)]
    with pytest.raises(ValueError):
        R.reduce_by_key(kv(spark, []), "key", "value", None)
    with pytest.raises(ValueError):
        R.reduce_by_key(kv(spark, []), "key", "value", "nothing")
    with pytest.raises(Exception, match="null key"):
        R.reduce_by_key(kv(spark, [(None, 1)]), "key", "value", "sum", nulls="raise").collect()
    assert got(R.reduce_by_key(kv(spark, [(1, 4294967295), (1, 2)]), "key", "value", "sum_u32")) == [(1, 1)]
    assert got(R.reduce_by_key(kv(spark, [(1, 5)]), "key", "value", custom(lambda a, b: a * b))) == [(1, 5)]
    assert got(R.reduce_by_key(kv(spark, [(1, 5), (1, 3), (1, 2)]), "key", "value", custom(lambda a, b: a * b))) == [(1, 30)]


def test_log(spark, tmp_path):
    log = R.KeyedLog("max")
    assert log.update(kv(spark, [(1, 2), (2, 1)])) and log.update(kv(spark, [(1, 7)]))
    with pytest.raises(RuntimeError):
        log.result()
    log.finish()
    assert not log.update(kv(spark, [(9, 9)]))
    assert list(log.rows()) == [(1, 7), (2, 1)]
    assert spark.read.parquet(log.write(str(tmp_path / "out"))).count() == 2
    assert log.status.done and log.status.rows == 2 and log.status.files >= 1 and log.status.bytes > 0
    with pytest.raises(ValueError):
        R.KeyedLog()


@few
@given(values=st.lists(st.integers(0, 20), max_size=40), block=st.integers(1, 7))
def test_running_values(spark, values, block):
    df = spark.createDataFrame([(3 * i, v) for i, v in enumerate(values)], "pos long, value long")
    by = lambda d: [r["o"] for r in d.orderBy("pos").collect()]
    n = len(values)
    assert by(O.with_previous(df, "pos", "value", "o", block=block)) == [values[i - 1] if i else None for i in range(n)]
    assert by(O.with_next(df, "pos", "value", "o", block=block)) == [values[i + 1] if i + 1 < n else None for i in range(n)]
    assert by(O.with_sum_before(df, "pos", "value", "o", block=block)) == [sum(values[:i]) for i in range(n)]
    assert by(O.with_max_before(df, "pos", "value", "o", block=block)) == [max(values[:i], default=None) for i in range(n)]


def test_sparse_positions_and_null_ones(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 300).tolist()
    df = spark.createDataFrame([(10**9 * i + v, v) for i, v in enumerate(values)], "pos long, value long").repartition(3)
    assert [r["o"] for r in O.with_previous(df, "pos", "value", "o").orderBy("pos").collect()] == [None, *values[:-1]]
    assert [r["o"] for r in O.with_sum_before(df, "pos", "value", "o").orderBy("pos").collect()] == [sum(values[:i]) for i in range(300)]
    with pytest.raises(ValueError, match="no position"):
        O.with_previous(df.unionByName(spark.createDataFrame([(None, 1)], "pos long, value long")), "pos", "value", "o")


def test_monotone_within_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g) if g < 4 else None, i, int(v)) for i, (g, v) in enumerate(zip(np.minimum(rng.integers(0, 9, 400), 4), rng.integers(0, 30, 400)))]
    top, kept = {}, []
    for g, i, v in rows:
        if v >= top.get(g, v):
            kept.append((g, i, v))
        top[g] = max(v, top.get(g, v))
    df = spark.createDataFrame(rows, "g long, pos long, v long")
    assert sorted(got(O.monotone_within(df, "g", "pos", "v")), key=lambda r: r[1]) == kept
    assert got(O.monotone_within(df.limit(0), "g", "pos", "v")) == []


def test_custom_fold_of_a_hot_key(spark):
    from keyloom.functions.reducers import Custom

    rows = kv(spark, [(1, i % 97) for i in range(5000)] + [(2, 5)]).repartition(3)
    small = custom(lambda a, b: (a + b) % 1000003)
    assert sorted(got(small.partial(rows, block=16, salts=4).groupBy("key").agg(small(F.col("value"))))) == [(1, sum(i % 97 for i in range(5000)) % 1000003), (2, 5)]
    assert isinstance(small, Custom)


def test_strict_order_starts_at_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "pos long, key long")
    assert got(O.order_violations(df, "pos", "key", strict=True).orderBy("pos")) == [(0, 0, 0), (2, 1, 1)]
    assert got(O.order_violations(df, "pos", "key")) == []


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def test_edges(spark, tmp_path):
    e = edges(spark, [(1, 2), (1, 2), (4, 4), (4, 9), (None, 1)])
    p = E.prepared(e)
    assert sorted(got(p)) == [(1, 2), (4, 9)]
    assert got(E.csr_index(p).orderBy("id")) == [(0, 0), (1, 0), (2, 4), (3, 4), (4, 4), (5, 8)]
    assert got(E.isolated_nodes(p)) == [(2,)]
    empty = edges(spark, [])
    assert got(E.csr_index(empty)) == [] and got(E.isolated_nodes(empty)) == [(0,)] and got(E.vertex_count(empty)) == [(0,)]
    sinks.text_edges(p, str(tmp_path / "t"))
    assert sorted(got(readers.text_edges(spark, str(tmp_path / "t")))) == [(1, 2), (4, 9)]
    sinks.csr_files(p, str(tmp_path / "c"))
    index = b"".join(bytes(r["data"]) for r in spark.read.parquet(str(tmp_path / "c/index")).orderBy("part", "seq").collect())
    assert np.frombuffer(index, "<u8").tolist() == [0, 0, 4, 4, 4, 8]
    (tmp_path / "b.bin").write_bytes(np.array([(7, 8), (9, 1)], "<u8").tobytes())
    rows = readers.binary_rows(spark, str(tmp_path / "b.bin"), [("src", "<u8"), ("dst", "<u8")])
    assert got(rows.orderBy("pos").select("pos", "src", "dst")) == [(0, 7, 8), (1, 9, 1)]


def test_bfs_and_leaves(spark):
    e = edges(spark, [(12, 1), (12, 2), (1, 3), (2, 3), (3, 12), (3, 4), (5, 6)])
    tree = V.bfs(e)
    assert sorted(got(tree)) == [(1, 1, 12), (2, 1, 12), (3, 2, 1), (4, 3, 3), (12, 3, 3)]
    assert 12 not in [r[0] for r in got(V.bfs(e, mark_source=True))]
    assert sorted(got(V.leaf_counts(tree))) == [(1, 2), (3, 2), (12, 3)]
    assert got(V.point_to_point(e, 12, 4).orderBy("hop")) == [(0, 12), (1, 1), (2, 3), (3, 4)]
    assert got(V.point_to_point(e, 12, 6)) == [] and got(V.point_to_point(e, 5, 5)) == [(0, 5)]
    assert got(V.bfs(edges(spark, []))) == [] and got(V.leaf_counts(V.bfs(edges(spark, [])))) == []
    assert sorted(got(V.bfs(e, max_steps=1))) == [(1, 1, 12), (2, 1, 12)]


def test_pagerank(spark):
    e = edges(spark, [(0, 1), (0, 2), (1, 2)])
    one = {r["id"]: r["val"] for r in V.pagerank(e).collect()}
    assert one == pytest.approx({0: 0.5, 1: 0.075 + 0.85 * 0.25})
    assert got(V.pagerank(edges(spark, []))) == []


def test_pagerank_of_many_steps(spark):
    """Every vertex sends in every step; the plan does not grow with the steps."""
    e = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 0), (3, 4), (4, 0)]
    out, val = {s: sum(a == s for a, _ in e) for s, _ in e}, {i: 0.2 for i in range(5)}
    for _ in range(50):
        new = {v: sum(val[s] / out[s] for s, t in e if t == v) for v in val}
        val = {v: 0.03 + 0.85 * new[v] if any(t == v for _, t in e) else val[v] for v in val}
    assert {r["id"]: r["val"] for r in V.pagerank(edges(spark, e), steps=50, least_change=None).collect()} == pytest.approx(val)
    two = {r["id"]: r["val"] for r in V.pagerank(edges(spark, e), steps=2).collect()}
    assert two[4] == pytest.approx(0.03 + 0.85 * 0.1)  # vertex 3 has no in-edge and still sends


def test_sequences(spark, tmp_path):
    text = "ACGT" * 200 + "N"
    df = spark.createDataFrame([(text,), ("AC",), (None,), ("",)], "t string")
    found = {r["kmer"]: r["n"] for r in S.kmer_count(df, "t", 4).collect()}
    expected = {}
    for i in range(len(text) - 4):
        expected[text[i : i + 4]] = expected.get(text[i : i + 4], 0) + 1
    assert found == expected
    lines = S.kmer_lines(S.kmer_next(df.where("t like '%N'"), "t", 4)).collect()
    assert "00011011 199 0 0 0" in [r["line"] for r in lines]
    long = {r["kmer"]: r["n"] for r in S.kmer_count(df, "t", 64).collect()}
    expected = {}
    for i in range(len(text) - 64):
        expected[text[i : i + 64]] = expected.get(text[i : i + 64], 0) + 1
    assert long == expected
    (tmp_path / "r.fq").write_text("@1\nACGT\n+\n!!!!\n@2\nTTTT\n+\n!!!!\n")
    assert got(readers.fastq(spark, str(tmp_path / "r.fq")).orderBy("id")) == [(0, "ACGT"), (1, "TTTT")]
    assert got(readers.fastq(spark, str(tmp_path / "r.fq"), first_only=True)) == [(0, "ACGT")]


def test_stream(spark, tmp_path):
    kv(spark, [(1, 2), (2, 3), (1, 5), (None, 1)]).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = updates.parquet_updates(spark, str(tmp_path / "in"), "key long, value long", 1)
    updates.drain(updates.reduce_stream(stream, "sum"), "drained", str(tmp_path / "ckpt"))
    assert sorted(got(spark.table("drained"))) == [(1, 7), (2, 3)]


def test_golden(spark):
    r = kv(spark, [(1, 1), (2, 2), (3, 3)])
    g = kv(spark, [(1, 1), (2, 9), (4, 4)])
    assert got(R.golden_compare(r, g)) == [(1, 1, 1, 1)]
    assert got(R.golden_compare(kv(spark, []), kv(spark, []))) == [(0, 0, 0, 0)]


def test_gather(spark):
    requests = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, 99)], "pos long, idx long")
    rows = spark.createDataFrame([(3, "c"), (5, "e")], "i long, v string")
    assert got(S.gather(requests, rows, "i", "v")) == [(0, 5, "e"), (1, 3, "c"), (2, 5, "e")]
    assert got(readers.rmat(spark, 3).agg(F.count("*"))) == [(8,)]
