"""The registered queries over the driver's tables; `oracles` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.reducers import clamped, custom
from keyloom.operators import edges as E
from keyloom.operators import ordered as O
from keyloom.operators import reduce as R
from keyloom.operators import sequences as S
from keyloom.plans import vertex as V
from keyloom.plans.checkpoints import shared_path
from keyloom.sources import readers, sinks
from keyloom.sources.readers import table
from keyloom.streaming import updates

Query = Callable[[SparkSession, str], DataFrame]
MASK, SOURCE, TARGET = 0xFFFFF, 12, 7
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def g_ord(spark: SparkSession, d: str) -> DataFrame:
    """Customers of orders that follow each other: strongly cyclic."""
    return E.chain_edges(table(spark, d, "orders"), "o_orderkey", "o_custkey")


def g_ordpart(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their parts in one id space: sparse and deep."""
    return E.prepared(raw_ordpart(spark, d))


def raw_ordpart(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def g_evt(spark: SparkSession, d: str) -> DataFrame:
    """Users of events that follow each other: small and dense."""
    return E.chain_edges(table(spark, d, "events"), "event_id", "user_id")


def hashed_supp(spark: SparkSession, d: str) -> DataFrame:
    value = (F.col("l_orderkey") * 1000003) % 4294967296
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), value.alias("value"))


@query
def histogram_masked(spark, d):
    return R.reduce_by_key(table(spark, d, "lineitem"), F.col("l_partkey").bitwiseAND(MASK), F.lit(1), "sum")


@query
def histogram_count(spark, d):
    return R.reduce_by_key(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", "count")


@query
def histogram_clamped(spark, d):
    return R.reduce_by_key(table(spark, d, "lineitem"), "l_suppkey", F.lit(1), clamped(500))


@query
def reduce_sum(spark, d):
    return R.reduce_by_key(table(spark, d, "orders"), "o_custkey", "o_orderkey", "sum")


@query
def reduce_min(spark, d):
    return R.reduce_by_key(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "min")


@query
def reduce_max(spark, d):
    return R.reduce_by_key(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "max")


@query
def reduce_first_min(spark, d):
    return R.reduce_by_key(table(spark, d, "orders"), "o_custkey", "o_orderdate", "first")


@query
def reduce_float_sum(spark, d):
    out = R.reduce_by_key(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "sum", ordered=False)
    return out.select("key", F.round("value", 4).alias("value")).orderBy("key")


@query
def reduce_sum_u32_wrap(spark, d):
    return R.reduce_by_key(hashed_supp(spark, d), "key", "value", "sum_u32")


@query
def reduce_sum_u64_wrap(spark, d):
    big = hashed_supp(spark, d).select("key", (F.col("value").cast("decimal(20,0)") * F.lit("4294967291").cast("decimal(10,0)")).cast("decimal(20,0)").alias("value"))
    return R.reduce_by_key(big, "key", "value", "sum_u64", ordered=False).select("key", F.col("value").cast("string").alias("value")).orderBy("key")


@query
def reduce_packed16(spark, d):
    return R.reduce_by_key(hashed_supp(spark, d), "key", "value", "packed16")


@query
def reduce_custom_max(spark, d):
    return R.reduce_by_key(table(spark, d, "orders"), "o_custkey", "o_orderkey", custom(lambda a, b: F.greatest(a, b)))


@query
def reduce_count4_vector(spark, d):
    kinds = {f"n_{c}": (F.col("l_linenumber") % 4 == i).cast("long") for i, c in enumerate("acgt")}
    return R.reduce_columns(table(spark, d, "lineitem"), "l_suppkey", kinds)


@query
def reduce_wide_key(spark, d):
    """Keys of 128 bits as 16 bytes, whose order is that of the number."""
    key = F.unhex(F.concat(F.lpad(F.hex("l_suppkey"), 16, "0"), F.lpad(F.hex("l_partkey"), 16, "0")))
    out = R.reduce_by_key(table(spark, d, "lineitem"), key, F.lit(1), "sum", ordered=False)
    return out.orderBy("key").select(F.lower(F.hex("key")).alias("key"), "value")


@query
def multi_endpoint_union(spark, d):
    log = R.KeyedLog("sum")
    one = F.lit(1).cast("long").alias("value")
    log.update(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), one))
    log.update(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), one))
    log.finish()
    return log.result()


@query
def golden_compare(spark, d):
    result = R.reduce_by_key(table(spark, d, "lineitem"), "l_orderkey", F.lit(1), "sum", ordered=False)
    golden = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 7).alias("value"))
    return R.golden_compare(result, golden)


@query
def reduce_summary(spark, d):
    return R.summary(R.reduce_by_key(table(spark, d, "lineitem"), "l_partkey", F.lit(1), "sum", ordered=False))


@query
def distinct_keys(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("different_items"))


@query
def edges_sort(spark, d):
    return E.sorted_edges(raw_ordpart(spark, d))


@query
def edges_merge_sorted(spark, d):
    return E.merged_sorted(raw_ordpart(spark, d), g_evt(spark, d))


@query
def edges_dedup(spark, d):
    return E.distinct_edges(raw_ordpart(spark, d))


@query
def edges_no_self_loops(spark, d):
    return E.no_self_loops(raw_ordpart(spark, d))


@query
def edges_to_text(spark, d):
    return E.edges_to_text(g_evt(spark, d))


@query
def edge_stats(spark, d):
    return E.edge_stats(g_ordpart(spark, d))


@query
def monotone_src_filter(spark, d):
    pos = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    return O.monotone(pos, "o_orderkey", "src").select("o_orderkey", "src")


@query
def monotone_dst_filter(spark, d):
    """Drops targets that go backwards within a source."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("dst"))
    return O.monotone_within(rows, "o_custkey", "o_orderkey", "dst")


@query
def check_sorted(spark, d):
    return O.order_violations(table(spark, d, "orders"), "o_orderkey", "o_custkey", row_bytes=12)


@query
def check_strictly_sorted(spark, d):
    return O.order_violations(table(spark, d, "events"), "event_id", "user_id", strict=True)


@query
def sorted_warning(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return E.sorted_warnings(rows, "o_orderkey")


@query
def graph_vertex_count(spark, d):
    return E.vertex_count(g_ordpart(spark, d))


@query
def out_degree(spark, d):
    return E.out_degree(g_ordpart(spark, d))


@query
def isolated_nodes(spark, d):
    return E.isolated_nodes(g_ordpart(spark, d))


@query
def csr_index(spark, d):
    return E.csr_index(g_ordpart(spark, d))


@query
def csr_matrix(spark, d):
    return E.csr_matrix(g_ord(spark, d))


@query
def frontier_expand(spark, d):
    frontier = spark.range(0, 100).select("id", (F.col("id") * 3).alias("val"))
    return V.expand(frontier, g_ord(spark, d), F.col("src") + F.col("val"), rows=100)


@query
def vertex_state_merge(spark, d):
    edges = g_evt(spark, d)
    frontier = spark.range(0, 50).select("id", F.col("id").alias("val"))
    messages = V.superstep(frontier, edges, F.col("src"), "first", rows=50)
    vertices = E.edge_stats(edges).collect()[0]["max_node"]
    state = readers.defaults(spark, 0 if vertices is None else vertices + 1, F.lit(None).cast("long"))
    return V.merge_state(state, messages, lambda old, new: new, lambda old, final, marked: old.isNull(), 1)


@query
def bfs_unvisited_anti(spark, d):
    reached = g_evt(spark, d).select(F.col("dst").alias("id")).distinct()
    visited = spark.range(0, 40).select(F.col("id").alias("seen"))
    return reached.join(visited, F.col("id") == F.col("seen"), "left_anti")


@query
def bfs_levels(spark, d):
    return V.bfs(g_ordpart(spark, d), SOURCE).select("vertex", "depth")


@query
def bfs_parents(spark, d):
    return V.bfs(g_ord(spark, d), SOURCE)


@query
def bfs_level_sizes(spark, d):
    return V.level_sizes(V.bfs(g_ord(spark, d), SOURCE))


@query
def bfs_frontier_stats(spark, d):
    return V.frontier_stats(V.bfs(g_evt(spark, d), SOURCE))


@query
def bfs_point_to_point(spark, d):
    return V.point_to_point(g_ord(spark, d), SOURCE, TARGET)


@query
def bfs_backtrace_path(spark, d):
    return V.backtrace(V.bfs(g_evt(spark, d), SOURCE), SOURCE, TARGET)


@query
def pagerank_1iter(spark, d):
    return V.pagerank(g_ordpart(spark, d)).select("id", F.round("val", 9).alias("rank"))


@query
def pagerank_raw(spark, d):
    return V.pagerank(g_ord(spark, d), store="raw").select("id", F.round("val", 9).alias("rank"))


@query
def pagerank_active(spark, d):
    return V.pagerank(g_ord(spark, d)).select("id", "active")


@query
def pagerank_2iter(spark, d):
    return V.pagerank(g_ord(spark, d), steps=2).select("id", F.round("val", 9).alias("rank"), "active")


@query
def pagerank_10iter(spark, d):
    return V.pagerank(g_ord(spark, d), steps=10, least_change=None).select("id", F.round("val", 9).alias("rank"))


@query
def bc_merge_flip_level(spark, d):
    tree = V.bfs(g_evt(spark, d), SOURCE)
    old = tree.where("depth = 1").groupBy(F.col("vertex").alias("key")).agg(F.lit(5).cast("long").alias("value"))
    return V.merge_flip(old, tree.select("vertex", "parent"))


@query
def bc_leaf_counts(spark, d):
    return V.leaf_counts(V.bfs(g_ord(spark, d), SOURCE))


@query
def gather_by_index(spark, d):
    requests = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("idx"))
    return S.gather(requests, table(spark, d, "part"), "p_partkey", "p_brand")


@query
def rmat_generate(spark, d):
    return readers.rmat(spark, scale=8)


@query
def rmat_quadrants(spark, d):
    return readers.quadrants(readers.rmat(spark, scale=8), 8)


@query
def kmer_count(spark, d):
    return S.kmer_count(table(spark, d, "documents"), "text", 4)


@query
def kmer_next_char(spark, d):
    return S.kmer_next(table(spark, d, "documents"), "text", 4, "aeio")


@query
def kmer_text_lines(spark, d):
    return S.kmer_lines(S.kmer_next(table(spark, d, "documents"), "text", 4, "aeio"), "aeio")


@query
def random_updates_reduce(spark, d):
    return R.reduce_by_key(readers.random_updates(spark, 10_000, 0xFFF), "key", "value", "sum")


@query
def result_file(spark, d):
    """A result written to a file and read again."""
    log = R.KeyedLog("sum")
    log.update(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.lit(1).cast("long").alias("value")))
    log.finish()
    return spark.read.parquet(log.write(shared_path(spark, "result")))


@query
def text_edges_round_trip(spark, d):
    path = shared_path(spark, "edges")
    sinks.text_edges(g_evt(spark, d), path)
    return readers.text_edges(spark, path)


@query
def packed_edges_round_trip(spark, d):
    path, fields = shared_path(spark, "edges"), [("src", "<u8"), ("dst", "<u8")]
    sinks.packed(g_evt(spark, d), fields).write.parquet(path)
    return readers.unpacked(spark, path, fields).select("src", "dst")


@query
def csr_files_round_trip(spark, d):
    """How often each offset stands in the index, and each target in the matrix."""
    path = shared_path(spark, "csr")
    sinks.csr_files(g_evt(spark, d), path)
    index = readers.unpacked(spark, f"{path}/index", [("value", "<u8")]).select(F.lit("index").alias("file"), "value")
    matrix = readers.unpacked(spark, f"{path}/matrix", [("value", "<u4")]).select(F.lit("matrix").alias("file"), "value")
    return index.unionByName(matrix).groupBy("file", "value").agg(F.count("*").alias("n"))


@query
def fastq_round_trip(spark, d):
    """A read for each customer, written as four lines and read again."""
    path = shared_path(spark, "reads")
    base = F.translate(F.md5(F.col("c_custkey").cast("string")), "0123456789abcdef", "ACGT" * 4)
    table(spark, d, "customer").select(F.concat_ws("\n", F.concat(F.lit("@"), "c_custkey"), base, F.lit("+"), F.repeat(F.lit("!"), 32)).alias("value")).write.text(path)
    return readers.fastq(spark, path).groupBy("seq").agg(F.count("*").alias("n"))


@query
def stream_reduce(spark, d):
    """Updates that arrive file by file, reduced as a stream to its end."""
    path, name = shared_path(spark, "updates"), f"drained_{abs(hash(d)) % 10**9}"
    table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("value")).repartition(4).write.parquet(path)
    stream = updates.parquet_updates(spark, path, "key long, value long", 2)
    updates.drain(updates.reduce_stream(stream, "sum"), name, shared_path(spark, "stream"))
    return spark.table(name)
