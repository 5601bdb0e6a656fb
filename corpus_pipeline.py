"""A training-corpus pipeline over ``documents``: every stage takes what the one before kept.

``STAGES`` are (name, function) with function(spark, docs, sf_dir) -> DataFrame; each result is written as
Parquet in the shared folder and read back as the next one's ``docs``.  All but the last return the columns
of ``docs``; where a stage changes a text, ``n_chars`` follows.  Null or empty texts pass every stage (the
mix takes no words of them, so they end there); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from tracewell.session import work_path

TOKENIZER = "word_bpe_49k.json"


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` counted anew."""
    return changed.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores 0.5 or more go.  It learns from labels of no held-out document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters in 3 documents or more stay in the one with the largest id only.  No document goes."""
    return _like(docs, line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group stays; of rows that repeat an id and a text, one."""
    links = ngram_join.link_documents(docs.select("doc_id", "text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    first = links.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("__id")).distinct()
    kept = docs.withColumn("__id", key).join(first, "__id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("__id", F.xxhash64("text")).orderBy(F.lit(0)))
    return kept.withColumn("__nth", nth).where("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass that the mix takes; the documents that a target cuts hold the words taken."""
    return _like(docs, mixing.mixed_texts(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each row's ids, and digest of the text decoded from them."""
    return bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: The first stage applies a trained model, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
