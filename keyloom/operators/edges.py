"""Edge tables (src, dst): cleaning, order, degrees and the compressed adjacency index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.ordered import with_next, with_previous, with_sum_before


def no_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def prepared(edges: DataFrame) -> DataFrame:
    """What an encoder keeps of an edge list: no loop, no repeat, no missing end."""
    return distinct_edges(no_self_loops(edges.where("src is not null and dst is not null").select("src", "dst")))


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def merged_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both lists in order, repeats kept."""
    return sorted_edges(a.unionByName(b))


def edges_to_text(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("%10d\t%10d", "src", "dst").alias("line"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_node"), F.count("*").alias("n_edges"))


def vertex_count(edges: DataFrame) -> DataFrame:
    """Vertices are numbered from 0 to the largest source."""
    return edges.agg((F.coalesce(F.max("src"), F.lit(-1)) + 1).alias("vertices"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("fanout"))


def isolated_nodes(edges: DataFrame) -> DataFrame:
    """Ids that an encoder skips between sources; before the first source id 0 is not counted. The gaps of distinct
    sorted sources telescope, so no order is needed."""
    span = F.max("src") - F.min("src") - F.count("src") + 1 + F.greatest(F.min("src") - 1, F.lit(0))
    return edges.select("src").distinct().agg(F.coalesce(span, F.lit(0)).alias("isolated"))


def csr_index(edges: DataFrame, entry_bytes: int = 4) -> DataFrame:
    """id, off for ids 0 to the vertex count: where a vertex's targets begin."""
    ids = _ids(edges)
    counted = ids.join(out_degree(edges), F.col("id") == F.col("src"), "left").select("id", (F.coalesce("fanout", F.lit(0)) * entry_bytes).alias("size"))
    return with_sum_before(counted, "id", "size", "off").select("id", F.col("off").cast("long").alias("off"))


def _ids(edges: DataFrame) -> DataFrame:
    """0 to the vertex count, made in parallel; the count is one number."""
    top = edges.agg(F.max("src")).collect()[0][0]
    return edges.sparkSession.range(0, -1 if top is None else top + 2)


def csr_matrix(edges: DataFrame) -> DataFrame:
    """dst in the order of the index, with the position each would have in the file."""
    return sorted_edges(edges).select("src", "dst")


def sorted_warnings(edges: DataFrame, pos: str) -> DataFrame:
    """The first place where an edge list is out of order: a smaller source, or a smaller target of the same one."""
    both = edges.select(F.col(pos).alias("pos"), F.struct("src", "dst").alias("edge"))
    return with_previous(both, "pos", "edge", "last").where("edge < last").orderBy("pos").limit(1).select("pos", "edge.src", "edge.dst")


def chain_edges(df: DataFrame, pos: str, node: str) -> DataFrame:
    """Edges from each row's node to the next row's, cleaned."""
    nxt = with_next(df.select(F.col(pos).cast("long").alias("_p"), F.col(node).alias("src")), "_p", "src", "dst")
    return prepared(nxt.select("src", "dst"))
