"""Command lines over edge files: python -m keyloom.cli COMMAND ..., `--help` for each.

Edges are text (`src<tab>dst`) or Parquet (src, dst) by the name's end (.parquet)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from keyloom.operators import edges as E
from keyloom.operators import ordered as O
from keyloom.plans import vertex as V
from keyloom.sources import readers, sinks
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("src", "dst") if path.rstrip("/").endswith(".parquet") else readers.text_edges(spark, path)


def write(edges: DataFrame, path: str) -> None:
    if path.rstrip("/").endswith(".parquet"):
        edges.select("src", "dst").write.parquet(path)
    else:
        sinks.text_edges(edges, path)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """pos, src: the rows' places, in Parquet by the files' names and the rows in them, in text as Spark reads it."""
    if not path.rstrip("/").endswith(".parquet"):
        return read(spark, path).select(F.monotonically_increasing_id().alias("pos"), "src")
    rows = spark.read.parquet(path)
    names = sorted(r[0] for r in rows.select("_metadata.file_name").distinct().collect())  # one for each file
    nth = F.array_position(F.lit(names), F.col("_metadata.file_name")) - 1
    return rows.select((nth * (1 << 40) + F.col("_metadata.row_index")).alias("pos"), "src")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="keyloom.cli", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *arguments: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=about, description=about)
        for a in arguments:
            own.add_argument(a)
        return own

    command("generate", "an R-MAT graph of 2^scale vertices", "out").add_argument("--scale", type=int, default=5)
    command("parse", "text edges to Parquet", "edges", "out")
    command("sort", "edges by source, then target", "edges", "out")
    command("merge", "two edge lists in order", "edges", "other", "out")
    command("encode", "cleaned edges to index and matrix files", "edges", "out").add_argument("--wide", action="store_true")
    command("tostring", "edges to text lines", "edges", "out")
    command("checksort", "the first place where edges are out of order", "edges")
    own = command("bfs", "breadth-first tree, or the path to a vertex", "edges", "out")
    own.add_argument("--source", type=int, default=12)
    own.add_argument("--target", type=int)
    own = command("pagerank", "ranks", "edges", "out")
    own.add_argument("--steps", type=int, default=1)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("keyloom").getOrCreate()
    if a.command == "generate":
        write(readers.rmat(spark, a.scale), a.out)
        return
    edges = read(spark, a.edges)
    if a.command in ("parse", "tostring"):
        write(edges, a.out)
    elif a.command == "sort":
        write(E.sorted_edges(edges), a.out)
    elif a.command == "merge":
        write(E.merged_sorted(edges, read(spark, a.other)), a.out)
    elif a.command == "encode":
        sinks.csr_files(E.prepared(edges), a.out, a.wide)
    elif a.command == "checksort":
        bad = O.order_violations(placed(spark, a.edges), "pos", "src").orderBy("pos").limit(1).collect()
        print(f"out of order: {bad[0]['key']} follows {bad[0]['last']}" if bad else "in order")
    elif a.command == "bfs":
        out = V.bfs(edges, a.source) if a.target is None else V.point_to_point(edges, a.source, a.target)
        out.write.parquet(a.out)
    else:
        V.pagerank(edges, a.steps).write.parquet(a.out)


if __name__ == "__main__":
    main()
