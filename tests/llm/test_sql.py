"""Operators that SQL can state, against DuckDB: on the small tables, and on a fixture of odd rows."""

import pandas as pd
import pytest
from helpers import same
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, mixing, quality_rules
from keyloom.llm.oracles import oracle_sql
from keyloom.llm.queries import queries

W = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, None, "en", "b", 9, "x"),
    (2, "", None, None, 0, "x"),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 0, None),
    (4, W, "en", "a", 0, ""),
    (4, W, "en", "a", 0, ""),
    (5, f"{W}\n{W}\n\n{W}\nHome | Menu\nAll rights reserved.\nok", "en", "c", 0, "x"),
    (6, "a a a a a a a a a a a a a a a a b c d e f g h i j k l m n o p q r s t u", "en", "c", 0, "x"),
    (7, "wörter – mit “Zeichen” 日本 語 # * $ % & | < >" * 20, "de", "é", 0, "x"),
    (None, "passage " + W + ".", "en", None, 0, "x"),
    (8, "LOUD!! WORDS!! ARE!! HERE!! AGAIN!! AND!! AGAIN!! AND!! MORE!! OF!! THEM!!", "en", "c", 0, "x"),
    (9, "start " + "word " * 3 + W.upper() + " end of it", "en", "zz", 0, "x"),
]
#: Names that the operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, size long, copies string"
ITEMS = [(1, W + "."), (2, W), (3, "too short"), (4, None), (5, ""), (2, W)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, COLUMNS)


@pytest.fixture(scope="module")
def tables():
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    d = pd.DataFrame(DOCS, columns=names)
    d["doc_id"] = d["doc_id"].astype("Int64")
    return {"documents": d, "benchmark": pd.DataFrame(ITEMS, columns=["item_id", "text"])}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_small_tables(spark, sf, name):
    same(queries()[name](spark, sf), oracle_sql()[name], sf)


def test_quality_rules(docs, tables):
    same(quality_rules.quality_rules(docs), oracle_sql()["op4_quality_rules"], tables=tables)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert got[1]["base_failed"] and not got[1]["kept"] and got[4]["kept"]
    assert got[6]["n_repeat_words"] == 16 and got[6]["base_failed"]
    assert not got[8]["kept"] and not got[8]["base_failed"]
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []
    clean = {r["doc_id"]: r["text"] for r in quality_rules.clean_text(docs).collect()}
    assert clean[5] == f"{W}\n{W}\n{W}" and clean[1] == ""


def test_mixing(docs, tables):
    got = mixing.mix(docs).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    same(got, oracle_sql()["op7_mixing"], tables=tables)
    assert mixing.mix(docs.limit(0)).collect() == []
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    copies = {repr(tuple(r["row"])): r["copies"] for r in mixing.mix(docs).collect()}
    seen = [repr(tuple(r)) for r in out.collect()]
    assert {x: seen.count(x) for x in set(seen)} == {k: v * (2 if k.startswith("(4,") else 1) for k, v in copies.items() if v}
    assert max(copies.values()) <= 3


def test_mixing_reaches_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10**6))
    per = mixing.mix(docs).groupBy("row.source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("s"), F.max("copies").alias("c")).collect()
    assert abs(sum(r["s"] for r in per) / sum(r["t"] for r in per) - 1) < 0.1
    assert max(r["c"] for r in per) <= 3


def test_decontamination(spark, docs, tables):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(decontaminate.contaminated(docs, items), oracle_sql()["op8_decontamination"], tables=tables)
    found = {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {4, 5, None, 9}
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 6, 7, 8]
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []


def test_containment_border(spark):
    """Of ten shingles, eight are enough and seven are not."""
    words = [f"w{i}" for i in range(14)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(8, "x " + " ".join(words[:12]) + " y"), (7, "x " + " ".join(words[:11]) + " y")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, item).collect()] == [8]


@pytest.mark.parametrize("entries", [0, 10**6])
@pytest.mark.parametrize("shared", [None, 5])
def test_rows_of_one_id_are_judged_by_their_own_text(spark, monkeypatch, shared, entries):
    """No row holds eight of the ten shingles but the third; the rest stay, though together they hold all."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ENTRIES", entries)
    words = [f"w{i}" for i in range(14)]
    item = [(1, " ".join(words))]
    rows = [(shared, " ".join(words[:9])), (shared, " ".join(words[5:])), (shared, "x " + " ".join(words)), (shared, "clean " * 9), (shared, None), (6, "y " + " ".join(words))]
    docs, items = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string"), spark.createDataFrame(item, "item_id long, text string")
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted((r["text"] for r in left.collect()), key=repr) == sorted((rows[i][1] for i in (0, 1, 3, 4)), key=repr)
    parts = docs.limit(2)
    assert decontaminate.decontaminate(parts, items).count() == 2
    ids = pd.DataFrame({"doc_id": pd.array([shared, shared], "Int64"), "text": [rows[0][1], rows[1][1]]})
    same(decontaminate.contaminated(parts, items), oracle_sql()["op8_decontamination"], tables={"documents": ids, "benchmark": pd.DataFrame(item, columns=["item_id", "text"])})


def test_without_broadcast(spark, docs, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(decontaminate.contaminated(docs, items), oracle_sql()["op8_decontamination"], tables=tables)
    got = mixing.mix(docs).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    same(got, oracle_sql()["op7_mixing"], tables=tables)
