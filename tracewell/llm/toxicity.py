"""Toxicity by multiple-instance learning: sentences are scored, noisy-or joins them to a document's score,
and only documents have labels.

A sentence's probability is a logistic function of the words and word beginnings it holds; a document is clean if none of its
sentences is toxic and neither is a constant leak, so its score is 1 - (1 - leak) * product(1 - p).  Both
are chosen by their chi-square against the labels, weights are trained with Adam on the documents' log
likelihood.  The trained sentences then show where a document offends.

Training uses ``TRAIN_DOCS`` labelled documents at most, those with the smallest hashed ids; the bound is a
parameter.  Every trait of theirs that passes the threshold takes part, however many there are.  Scoring reads
every whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 20_000
#: A word takes part if it is in so many documents and its chi-square is significant at 1 in 1000.
WORD_DOCS, CHI_SQUARE = 5, 10.83
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of every sentence that has a word."""
    for m in _SENTENCE.finditer(text or ""):
        if words := set(_WORD.findall(m[0].lower())):
            yield m.start(), m.end(), words


def traits(word: str) -> list[str]:
    """The word and its beginnings of 4 to 7 letters, which stand for inflections never seen in training."""
    return [word, *(f"{word[:k]}*" for k in range(4, min(8, len(word))))]


class _Known(dict):
    """Numbers of a word's traits that the model knows; forgets its words when there are too many."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = tuple(self.numbers[t] for t in traits(word) if t in self.numbers)
        return found


def _hits(words: set[str], known: _Known) -> set[int]:
    return {i for w in words for i in known[w]}


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(text, y) of the labelled documents to learn from.  Of several labels of one id the highest counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # this many rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")


def fit_noisy_or(bags: list[list[np.ndarray]], empty: np.ndarray, y: np.ndarray, words: int, epochs: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """(weights, bias, leak logit) from each document's sentences as word numbers, and its number of other sentences."""
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    rows = [s for b in bags for s in b]
    sentence = np.repeat(np.arange(len(rows)), [len(s) for s in rows])
    word = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    n = max(1, len(y))
    x = np.zeros(words + 2)  # weights, bias, leak
    x[-2], x[-1] = -7.0, np.log((y.sum() * 0.1 + 0.5) / (n + 1))
    first, second = np.zeros_like(x), np.zeros_like(x)
    softplus = lambda v: np.logaddexp(0, v)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for t in range(1, epochs + 1):
        s = np.bincount(sentence, x[word], len(rows)) + x[-2]
        a = softplus(x[-1]) + empty * softplus(x[-2]) + np.bincount(doc, softplus(s), len(bags))
        da = np.where(y > 0, -1 / np.expm1(np.clip(a, 1e-6, 50)), 1.0) / n
        ds = da[doc] * sigmoid(s)
        g = np.concatenate([np.bincount(word, ds[sentence], words) + decay * x[:-2], [ds.sum() + (da * empty).sum() * sigmoid(x[-2]), da.sum() * sigmoid(x[-1])]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return x[:-2], float(x[-2]), float(x[-1])


def train_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """The model: {"weights": {trait: weight}, "bias": ..., "leak": ...}.  Without labels it knows no word and calls nothing toxic."""
    sample = training_sample(docs, labels, train_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, toxic = Counter(), Counter()

        def out():
            words = list(total)
            found = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())], ["word", "docs", "toxic"])
            total.clear(), toxic.clear()
            return found

        for batch in _slices(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                own = {t for w in set(_WORD.findall((text or "").lower())) for t in traits(w)}
                total.update(own)
                if y > 0:
                    toxic.update(own)
            n = len(batch)
            total[""] += n  # the empty word counts documents
            toxic[""] += sum(y > 0 for y in batch.column("y").to_pylist())
            if len(total) > 200_000:
                yield out()
        yield out()

    counted = sample.mapInArrow(count, "word string, docs bigint, toxic bigint").groupBy("word").agg(F.sum("docs").alias("n"), F.sum("toxic").alias("p")).where(F.col("n") >= WORD_DOCS)
    whole = counted.where("word = ''").select("n", "p").first()
    if whole is None:
        return {"weights": {}, "bias": -20.0, "leak": -3.0}
    n, p = float(whole.n), float(whole.p)
    expected = F.col("n") * p / n
    chi = (F.col("p") - expected) ** 2 / (expected * (1 - F.col("n") / (n + 1.0)) + 1e-9)
    # those of a bounded sample that pass, in a fixed order
    words = [r.word for r in counted.where("word <> ''").where(chi >= CHI_SQUARE).select("word", chi.alias("chi")).orderBy(F.col("chi").desc(), "word").collect()]
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(number.value)
        for batch in _slices(batches):
            bags, empty = [], []
            for text in batch.column("text").to_pylist():
                own = [sorted(_hits(s, known)) for _, _, s in sentences(text)]
                bags.append([s for s in own if s])
                empty.append(len(own) - len(bags[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(empty, pa.int32()), batch.column("y").cast(pa.int32())], ["bags", "empty", "y"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, empty, y = [], [], []
        for batch in batches:
            for b in batch.column("bags"):
                bags.append([np.asarray(s.values, np.int32) for s in b.values] if len(b.values) else [])
            empty += batch.column("empty").to_pylist()
            y += batch.column("y").to_pylist()
        w, bias, leak = fit_noisy_or(bags, np.array(empty, float), np.array(y), len(words))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"w": w.tolist(), "bias": bias, "leak": leak})])], ["model"])

    rows = sample.mapInArrow(features, "bags array<array<int>>, empty int, y int")
    model = json.loads(rows.repartition(1).mapInArrow(train, "model string").first().model)  # a bounded sample
    return {"weights": dict(zip(words, model["w"])), "bias": model["bias"], "leak": model["leak"]}


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``offending``: [(start, end, probability)] of sentences at or above ``threshold``.

    A null or empty text has no sentence and scores the leak.  All columns and rows are kept (columns named
    like the new ones are replaced); the rows' order within a task too.
    """
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = "score double, predicted int, offending array<struct<start: int, end: int, probability: double>>"
    base = docs.drop("score", "predicted", "offending")
    schema = StructType([*base.schema.fields, *StructType.fromDDL(added).fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, bias, leak = list(m["weights"].values()), m["bias"], np.logaddexp(0, m["leak"])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        idle = float(np.logaddexp(0, bias))
        known = _Known({t: i for i, t in enumerate(m["weights"])})
        for batch in _slices(batches):
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                a, own = float(leak), []
                for start, end, words in sentences(text):
                    if hits := _hits(words, known):
                        s = float(np.logaddexp(0, bias + sum(weights[i] for i in hits)))
                        if (p := -np.expm1(-s)) >= threshold:
                            own.append((start, end, float(p)))
                        a += s
                    else:
                        a += idle
                scores.append(float(-np.expm1(-a)))
                spans.append([dict(zip(("start", "end", "probability"), x)) for x in own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(spans, kind)], schema.names)

    return base.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
