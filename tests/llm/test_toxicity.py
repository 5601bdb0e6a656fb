"""Noisy-or toxicity against plain Python on all words and sentences, and its accuracy on rows never learned from."""

import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tracewell.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def beginnings(word):
    return {word} | {word[:k] + "*" for k in range(4, 8) if len(word) > k}


def test_traits_and_scores_are_those_of_a_plain_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train_toxicity(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    y = {r.doc_id: r.toxic for r in labels.collect() if crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    n, p = len(y), sum(y.values())
    total, toxic = Counter(), Counter()
    for i, label in y.items():
        own = set().union(*map(beginnings, re.findall(r"\w+", texts[i].lower())))
        total.update(own)
        toxic.update(own if label else ())
    chi = {t: (toxic[t] - c * p / n) ** 2 / (c * p / n * (1 - c / (n + 1)) + 1e-9) for t, c in total.items() if c >= 5}
    assert set(model["weights"]) == {t for t, x in chi.items() if x >= 10.83}

    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for r in toxicity.score_toxicity(docs, model).collect():
        clean = 1 - sigmoid(model["leak"])
        for s in re.split(r"[.!?\n]+", texts[r.doc_id]):
            words = set(re.findall(r"\w+", s.lower()))
            if words:
                hits = set().union(*map(beginnings, words)) & set(model["weights"])
                clean *= 1 - sigmoid(model["bias"] + sum(model["weights"][t] for t in hits))
        # an id of several rows has one of their texts here
        assert r.text != texts[r.doc_id] or r.score == pytest.approx(1 - clean, abs=1e-9)


def test_no_limit_on_traits(spark):
    bad = " ".join(f"w{i:03}" for i in range(700))
    docs = spark.createDataFrame([(i, bad if i % 2 else "all is well") for i in range(60)] + [(99, "w699"), (100, "well")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    assert {f"w{i:03}" for i in range(700)} <= set(model["weights"])


def test_accuracy_on_rows_never_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op5_toxicity_noisy_or"](spark, sf).where("held_out").select("doc_id", "predicted")
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert len(rows) > 500 and sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.97
