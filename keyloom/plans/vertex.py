"""Vertex programs: expand a frontier over the edges, reduce the messages, merge them into the state, repeat.

Each superstep is one join and one aggregation; its result is written to the shared folder, which cuts the lineage and
gives the frontier's size, the test for the end. The edges are dealt by source once and kept for all supersteps; a
frontier of up to `SMALL_FRONTIER` rows is broadcast, so that early and late supersteps move no edge."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.reducers import Reducer, reducer
from keyloom.operators.edges import out_degree
from keyloom.plans.checkpoints import cut

SMALL_FRONTIER = 200_000  # rows of two numbers
MERGE = 8  # levels whose tables become one
EdgeProgram = Callable[[Column, Column, Column], Column]


def kept_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").repartition("src").persist(StorageLevel.MEMORY_AND_DISK)


def expand(frontier: DataFrame, edges: DataFrame, message: Column, rows: int | None = None) -> DataFrame:
    """dst, msg: what each active vertex (id, val) sends along its out-edges. `message` sees src, val and, if it is a
    column of `edges`, fanout. `rows` is the frontier's size, where it is known; else it is counted."""
    small = (frontier.count() if rows is None else rows) <= SMALL_FRONTIER
    near = F.broadcast(frontier) if small else frontier
    return edges.join(near, F.col("src") == F.col("id")).select("dst", message.alias("msg"))


def superstep(frontier: DataFrame, edges: DataFrame, message: Column, by: str | Reducer, rows: int | None = None) -> DataFrame:
    """id, msg: the reduced messages of one step."""
    return expand(frontier, edges, message, rows).groupBy(F.col("dst").alias("id")).agg(reducer(by)(F.col("msg")).alias("msg"))


def merge_state(state: DataFrame, messages: DataFrame, finalize: Callable[[Column, Column], Column], active: Callable[[Column, Column, Column], Column], step: int, store: str = "final") -> DataFrame:
    """id, iteration, val, active for every vertex. A vertex with a message gets `finalize(old, message)`; it is active
    if `active(old, final, marked)` says so, where marked means that the last step changed it; only active ones store
    (`final`, or with `store="raw"` the bare message) and are stamped with the next step."""
    both = state.join(messages, "id", "left")
    final = finalize(F.col("val"), F.col("msg"))
    is_active = F.coalesce(F.col("msg").isNotNull() & active(F.col("val"), final, F.col("iteration") == step), F.lit(False))
    marked = both.withColumn("_final", final).withColumn("active", is_active)
    return marked.select(
        "id",
        F.when(F.col("active"), F.lit(step + 1)).otherwise(F.col("iteration")).cast("int").alias("iteration"),
        F.when(F.col("active"), F.col("_final") if store == "final" else F.col("msg")).otherwise(F.col("val")).alias("val"),
        "active",
    )


def union(tables: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, tables)


def bfs(edges: DataFrame, source: int = 12, mark_source: bool = False, until: int | None = None, max_steps: int | None = None) -> DataFrame:
    """vertex, depth, parent of the vertices that can be reached; of several parents the smallest id.

    The source itself is not marked unless asked for, so a cycle gives it a depth and a parent like any vertex.
    `until` stops with the step that reaches this vertex."""
    spark = edges.sparkSession
    own = kept_edges(edges)
    try:
        frontier = spark.range(source, source + 1).select("id")
        levels: list[DataFrame] = []
        visited = frontier.select(F.col("id").alias("seen")) if mark_source else None
        size, depth = 1, 0
        while max_steps is None or depth < max_steps:
            depth += 1
            found = superstep(frontier.withColumn("val", F.col("id")), own, F.col("src"), "first", size)
            if visited is not None:
                found = found.join(visited, F.col("id") == F.col("seen"), "left_anti")
            level = cut(found.select(F.col("id").alias("vertex"), F.lit(depth).alias("depth"), F.col("msg").alias("parent")))
            size, there = level.agg(F.count("*"), F.count_if(F.col("vertex") == F.lit(until))).collect()[0]
            if not size:
                break
            levels.append(level)
            frontier, reached = level.select(F.col("vertex").alias("id")), level.select(F.col("vertex").alias("seen"))
            visited = reached if visited is None else visited.unionByName(reached)
            if depth % MERGE == 0:  # one table instead of one a level: plans and numbers of files stay small
                levels, visited = [cut(union(levels).coalesce(spark.sparkContext.defaultParallelism))], cut(visited)
            if there:
                break
        return cut(union([spark.createDataFrame([], "vertex long, depth int, parent long"), *levels]))
    finally:
        own.unpersist()


def level_sizes(tree: DataFrame) -> DataFrame:
    return tree.groupBy("depth").agg(F.count("*").alias("vertices"))


def backtrace(tree: DataFrame, source: int, target: int) -> DataFrame:
    """hop, vertex: the tree's path from the source (hop 0) to the target; empty if it was not reached. A step looks
    up one vertex of one level, so the path and nothing else comes to the driver."""
    here = tree.where(F.col("vertex") == target).orderBy("depth").limit(1).collect()
    path: list[tuple[int, int]] = []
    while here:
        vertex, depth, parent = here[0]["vertex"], here[0]["depth"], here[0]["parent"]
        path.append((depth, vertex))
        if depth == 1:
            path.append((0, source))
            break
        here = tree.where((F.col("vertex") == parent) & (F.col("depth") == depth - 1)).collect()
    return tree.sparkSession.createDataFrame(path, "hop int, vertex long")


def point_to_point(edges: DataFrame, source: int, target: int) -> DataFrame:
    """hop, vertex of a shortest path."""
    if source == target:
        return edges.sparkSession.createDataFrame([(0, source)], "hop int, vertex long")
    return backtrace(bfs(edges, source, mark_source=True, until=target), source, target)


def frontier_stats(tree: DataFrame) -> DataFrame:
    """depth, vertices, total, ratio, pages: a level's vertices, the times they are touched (once), and the 8 KiB pages
    of an index of eight-byte entries that they lie in."""
    return tree.groupBy("depth").agg(
        F.count("*").alias("vertices"),
        F.count("*").alias("total"),
        (F.count("*") / F.count("*")).alias("ratio"),
        F.count_distinct(F.shiftright(F.col("vertex") * 8, 13)).alias("pages"),
    )


def pagerank(edges: DataFrame, steps: int = 1, damping: float = 0.85, store: str = "final", least_change: float | None = 1e-4) -> DataFrame:
    """id, iteration, val, active. A vertex without in-edges keeps its value; one without out-edges sends nothing.
    Every vertex sends its stored value in every step. What it receives is stored by a vertex that is active: it stored
    in the step before (in the first one all count as such) and changes by `least_change` or more. `least_change=None`
    lets every vertex with a message store, the plain iteration."""
    spark = edges.sparkSession
    top = edges.agg(F.max("src")).collect()[0][0]
    n = 0 if top is None else top + 1
    if not n:
        return spark.createDataFrame([], "id long, iteration int, val double, active boolean")
    degree = out_degree(edges)
    weighted = edges.join(degree, "src").repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        state = spark.range(n).select("id", F.lit(0).alias("iteration"), F.lit(1.0 / n).alias("val"))
        for step in range(steps):
            messages = superstep(state.select("id", "val"), weighted, F.col("val") / F.col("fanout"), "sum", n)
            stores = (lambda old, final, marked: F.lit(True)) if least_change is None else (lambda old, final, marked: marked & (F.abs(old - final) >= least_change))
            state = cut(merge_state(state.select("id", "iteration", "val"), messages.where(F.col("id") < n), lambda old, new: F.lit((1 - damping) / n) + F.lit(damping) * new, stores, step, store))
        return state
    finally:
        weighted.unpersist()


def merge_flip(old: DataFrame, level: DataFrame) -> DataFrame:
    """key, value: the rows of `old` as they are, and for each vertex of the level its own count in `old`, or 1, sent to
    its parent."""
    counts = old.select(F.col("key").alias("vertex"), F.col("value").alias("_n"))
    up = level.join(counts, "vertex", "left").select(F.col("parent").alias("key"), F.coalesce("_n", F.lit(1).cast("long")).alias("value"))
    return up.unionByName(old.select("key", "value"))


def leaf_counts(tree: DataFrame) -> DataFrame:
    """vertex, leaves: how many leaves of the breadth-first tree lie below each vertex with a child; the levels are
    folded from the deepest to the first. A source that is found again is one more leaf of its level."""
    spark = tree.sparkSession
    depths = sorted((r["depth"] for r in tree.select("depth").distinct().collect()), reverse=True)
    total = spark.createDataFrame([], "key long, value long")
    for depth in depths:
        level = tree.where(F.col("depth") == depth).select("vertex", "parent")
        total = cut(merge_flip(total, level).groupBy("key").agg(F.sum("value").alias("value")))
    return total.select(F.col("key").alias("vertex"), F.col("value").alias("leaves"))
