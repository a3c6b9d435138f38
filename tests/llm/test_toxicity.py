import itertools
import zlib

import numpy as np
import pandas as pd
import pytest

from keyloom.llm import toxicity
from pyspark.sql import functions as F


def test_marginals():
    rng = np.random.default_rng(0)
    scores, steps = [rng.normal(size=n) for n in (0, 1, 2, 5, 7)], (-0.1, -2.0, -1.0, -0.3)
    s = np.array(steps).reshape(2, 2)
    expected = np.zeros(4)
    for x, got in zip(scores, toxicity.marginals(scores, steps)):
        weight, pairs = np.zeros((len(x), 2)), np.zeros(4)
        for z in itertools.product((0, 1), repeat=len(x)):
            v = np.exp(sum(a * b for a, b in zip(x, z)) + sum(s[a, b] for a, b in zip(z, z[1:])))
            for i, state in enumerate(z):
                weight[i, state] += v
            for a, b in zip(z, z[1:]):
                pairs[2 * a + b] += v
        if len(x) > 1:
            expected += pairs / weight[0].sum()
        assert np.allclose(got, np.log(weight[:, 1] / weight[:, 0])) if len(x) else len(got) == 0
    assert np.allclose(toxicity.forward_backward(scores, steps, count=True)[1], expected)


def test_a_word_of_a_fortieth_of_the_toxic_documents_marks():
    types = toxicity.Types()
    docs = [types.read(f"a{i} {'slur' if i < 25 else 'plain'} b{i}") for i in range(1000)] + [types.read(f"c{i} plain d{i}") for i in range(1000)]
    marks = toxicity.distant_labels(types, docs, np.repeat([1.0, 0.0], 1000))
    assert marks[types.names["=slur"]] and not marks[types.names["=plain"]]


@pytest.fixture(scope="module")
def tables(spark, sf):
    d = f"{sf}/../sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    scored = toxicity.score(docs, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    assert all(o == (zlib.crc32(str(i).encode()) % 3 == 1) for i, o in zip(scored["doc_id"], scored["out"]))
    own = scored[scored["out"]]
    bad, good = own[own["toxic"] == 1], own[own["toxic"] == 0]
    assert bad["predicted"].mean() >= 0.75  # labels are noisy: the rest hold no word that toxic documents share
    assert good["predicted"].mean() <= 0.02
    assert ((scored["score"] >= 0) & (scored["score"] <= 1)).all()


def test_odd_rows(spark, model):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, " \n", 1), (2, "you idiot , you scum, idiot loser", 1), (2, "you idiot , you scum, idiot loser", 1)], "doc_id long, text string, score int")
    got = toxicity.score(df, model).collect()
    low = {r["score"] for r in got if r["doc_id"] != 2}
    assert len(low) == 1 and low.pop() < 0.5
    bad = [r for r in got if r["doc_id"] == 2]
    assert len(bad) == 2 and all(r["predicted"] == 1 for r in bad)
    text = "you idiot , you scum, idiot loser"
    assert "idiot" in " ".join(text[s["begin"] : s["end"]] for s in bad[0]["spans"])
    assert toxicity.score(df.limit(0), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.clean(docs, none).collect() == docs.collect()


def test_labels_of_held_out_rows_are_not_read(tables, model):
    docs, labels = tables
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, wrong)
    assert again.curve == model.curve and again.weights == model.weights
    assert pd.Series(model.weights).notna().all()
