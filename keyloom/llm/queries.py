"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, html_text, mixing, near_dedup, quality_rules, substring_fm, suffix_merge, token_counts, token_files, toxicity
from keyloom.llm.common import fresh, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op2_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_fm.dedup_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op6_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_merge.dedup_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(fresh(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with how many benchmark items each holds and the first of them."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_substring_fm": op2_substring_fm,
        "op3_near_dedup": op3_near_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_token_counts": op5_token_counts,
        "op6_suffix_merge": op6_suffix_merge,
        "op7_mixing": op7_mixing,
        "op8_decontamination": op8_decontamination,
        "op9_html_text": op9_html_text,
        "op10_token_files": op10_token_files,
    }
