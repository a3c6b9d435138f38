"""The corpus pipeline: documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. No SQL states the whole (the classifier and the token files are beyond it); tests hold the stages against
brute force.

Defined cases: a null, empty or blank text is not toxic, has no copy, holds no benchmark item and has size 0, which its
source's rate takes like any; it ends as a document with the end id alone. Rows without an id are judged by their texts
and come first in the files. Of rows with equal texts one stays, whatever their ids; columns beyond those of documents
stay with their rows up to the last stage, whatever they are called; an empty table gives empty files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from keyloom.llm.common import drop, table, unique_path
from keyloom.llm.queries import vocabulary

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return near_dedup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight takes it."""
    return mixing.emit(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: doc_id, start, n_tokens, ids_crc32."""
    return token_files.round_trip(docs, vocabulary()).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. A stage's files are deleted once the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = unique_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs, done = spark.read.parquet(out), before
        before = out
        if done:
            drop(spark, done)
    result = STAGES[-1][1](spark, docs, sf_dir)  # its files are written; what it returns reads them
    if before:
        drop(spark, before)
    return result
