"""Language-model scores as masked pseudo-likelihood.

A small network predicts every word of a text from the ``WINDOW`` words on both of its sides, the word itself
left out; the sum of the conditional log-probabilities scores the document.  The network adds one embedding
per neighbour and offset, takes a tanh, and predicts in two steps: the word's class, then the word within
its class.  Words beyond the network's vocabulary are predicted as one of ``UNKNOWN`` hashed buckets, times the
word's share of its bucket.  The shares stay in a Spark table, a row per distinct word, to which scoring joins
the words of the documents.  Words are told apart there by 64-bit hashes.

Word counts are taken over all documents.  Texts become word numbers once, in a table (``numbered``) that every
round of training and the scoring read.  Training goes over the whole corpus in rounds: every task runs
Adagrad on its own documents, on every ``STRIDE``-th word as a target, starting from the common weights, and
the tasks' weights are averaged by the words they saw.  So what is gathered grows with the corpus, and what
reaches the driver (one set of weights, one vocabulary, one sum per bucket) does not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import saved

#: Words per class, classes, hashed unknowns among them; neighbours on each side; width of the network.
MEMBERS, CLASSES, UNKNOWN, WINDOW, WIDTH = 32, 32, 32, 2, 16
STRIDE, ROUNDS, BATCH, RATE = 1, 2, 1024, 0.1
#: Weights that travel in one row.
PART = 1 << 14
VOCABULARY = MEMBERS * CLASSES - UNKNOWN
#: Number of the gap beyond a text's ends.
GAP = MEMBERS * CLASSES
#: Type of a word's number.
NUMBER = np.dtype("<i2")
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
SHAPES = {"near": (len(OFFSETS), GAP + 1, WIDTH), "classes": (WIDTH, CLASSES), "class_bias": (CLASSES,), "members": (CLASSES, WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the network's arrays in one flat array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        out[name] = flat[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    return out


def first_weights(counts: np.ndarray, seed: int) -> np.ndarray:
    """Small random embeddings; biases at the words' frequencies."""
    flat = np.random.default_rng(seed).standard_normal(sum(int(np.prod(s)) for s in SHAPES.values())).astype(np.float32) * 0.1
    w = unpack(flat)
    p = (counts + 1.0) / (counts + 1.0).sum()
    p = p.reshape(CLASSES, MEMBERS)
    w["class_bias"][:] = np.log(p.sum(1))
    w["member_bias"][:] = np.log(p / p.sum(1, keepdims=True))
    return flat


def _hash(word: bytes) -> int:
    """A signed 64-bit hash."""
    return (xxhash.xxh64_intdigest(word) ^ (1 << 63)) - (1 << 63)


class _Numbers(dict):
    """Numbers of words; unknown ones get that of a hashed bucket and are not remembered for ever."""

    def __init__(self, words: list[str]):
        self.known = {w.encode(): i for i, w in enumerate(words)}
        self.hashes: dict[bytes, int] = {}
        super().__init__(self.known)

    def __missing__(self, word: bytes) -> int:
        self.hashes[word] = h = _hash(word)
        self[word] = number = VOCABULARY + h % UNKNOWN
        return number

    def trim(self, most: int = 500_000) -> None:
        if len(self.hashes) > most:
            self.hashes.clear()
            self.clear()
            self.update(self.known)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _numbered(text: str | None, numbers: _Numbers) -> tuple[bytes, list[int], list[int]]:
    """(word numbers, hashes and counts of the distinct words beyond the vocabulary) of a text."""
    words = _words(text)
    ids = np.fromiter(map(numbers.__getitem__, words), NUMBER, len(words))
    rare = Counter(compress(words, (ids >= VOCABULARY).tolist()))
    return ids.tobytes(), [numbers.hashes[w] for w in rare], list(rare.values())


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers of all texts with gaps around each, places of the words, words per text)."""
    gap = np.full(WINDOW, GAP, NUMBER)
    ids = [np.frombuffer(x.as_buffer(), NUMBER) for x in texts]
    flat = np.concatenate([y for x in ids for y in (gap, x, gap)]) if ids else np.empty(0, NUMBER)
    return flat.astype(np.int64), np.flatnonzero(flat != GAP), np.array([len(x) for x in ids], np.int64)


def _hidden(w: dict, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = w["near"][0][flat[at + OFFSETS[0]]]
    for k, o in enumerate(OFFSETS[1:], 1):
        h += w["near"][k][flat[at + o]]
    return np.tanh(h, out=h)


def _by_class(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(order of the places by the class of their word, the classes with their places in that order)."""
    group = (flat[at] // MEMBERS).astype(np.int16)
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return order, [(int(group[a]), slice(a, b)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)])]


def _scores(w: dict, h: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised scores of the classes, and of the members of each place's class; a column a place."""
    d = w["classes"].T @ h
    d += w["class_bias"][:, None]
    e = np.empty((MEMBERS, h.shape[1]), np.float32)
    for k, own in spans:
        np.matmul(w["members"][k].T, h[:, own], out=e[:, own])
        e[:, own] += w["member_bias"][k][:, None]
    return d, e


def log_probabilities(w: dict, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of every word at the places ``at``, given its neighbours."""
    out = np.empty(len(at), np.float64)
    for i in range(0, len(at), 1 << 13):
        order, spans = _by_class(flat, at[i : i + (1 << 13)])
        own = at[i + order]
        target, rows, total = flat[own], np.arange(len(own)), np.zeros(len(own))
        d, e = _scores(w, np.ascontiguousarray(_hidden(w, flat, own).T), spans)
        for x, picked in ((d, target // MEMBERS), (e, target % MEMBERS)):
            x -= x.max(0)
            total += x[picked, rows]
            total -= np.log(np.exp(x, out=x).sum(0))
        out[i + order] = total
    return out


def _missed(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Probabilities from scores, less one at the target: the gradient of the scores."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    x[target, np.arange(len(target))] -= 1
    return x


def train_step(w: dict, g: dict, sums: dict, flat: np.ndarray, at: np.ndarray) -> None:
    """One Adagrad step on the targets at ``at``; ``g`` is room for gradients, ``sums`` their squares so far."""
    n = len(at)
    order, spans = _by_class(flat, at)
    at = at[order]
    target = flat[at]
    near = np.stack([flat[at + o] + k * (GAP + 1) for k, o in enumerate(OFFSETS)]).astype(np.int16)
    rows = w["near"].reshape(-1, WIDTH)
    h = rows.take(near[0], 0)
    for x in near[1:]:
        h += rows.take(x, 0)
    np.tanh(h, out=h)
    # a row a place; the last lane of 1 meets the biases
    lanes = np.concatenate([h, np.ones((n, 1), np.float32)], 1)
    members = np.concatenate([w["members"], w["member_bias"][:, None]], 1)
    d = np.concatenate([w["classes"], w["class_bias"][None]]).T @ lanes.T
    e = np.empty((n, MEMBERS), np.float32)
    for k, own in spans:
        np.dot(lanes[own], members[k], out=e[own])
    d = _missed(d, target // MEMBERS)
    e = np.ascontiguousarray(_missed(np.ascontiguousarray(e.T), target % MEMBERS).T)
    missed = (d @ lanes).T
    g["classes"][:], g["class_bias"][:] = missed[:WIDTH], missed[WIDTH]
    missed, dh, back = np.zeros_like(members), np.empty((n, WIDTH), np.float32), np.ascontiguousarray(w["members"].transpose(0, 2, 1))
    for k, own in spans:
        np.dot(lanes[own].T, e[own], out=missed[k])
        np.dot(e[own], back[k], out=dh[own])
    g["members"][:], g["member_bias"][:] = missed[:, :WIDTH], missed[:, WIDTH]
    dh += d.T @ w["classes"].T
    dh *= 1 - h * h
    for name, x in g.items():
        if name != "near":
            x /= n
            sums[name] += x * x
            w[name] -= RATE * x / (np.sqrt(sums[name]) + 1e-6)
    # neighbours by offset and word: only those that occur have a gradient, and only these move
    near = near.ravel()
    order = np.argsort(near, kind="stable")
    near = near[order]
    first = np.flatnonzero(np.diff(near, prepend=-1))
    touched = near[first]
    x = np.add.reduceat(dh.take(order % n, 0), first, axis=0)
    x /= n
    g["near"][:] = 0
    g["near"].reshape(-1, WIDTH)[touched] = x
    squares = sums["near"].reshape(-1, WIDTH)
    new = squares.take(touched, 0) + x * x
    squares[touched] = new
    rows[touched] = rows.take(touched, 0) - RATE * x / (np.sqrt(new) + 1e-6)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, h, n) over all documents; h is the word's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            found = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in total], pa.string()), pa.array([_hash(w) for w in total], pa.int64()), pa.array(total.values(), pa.int64())], ["word", "h", "n"])
            total.clear()
            return found

        for batch in _slices(batches):
            for text in batch.column("text").to_pylist():
                total.update(_words(text))
            if len(total) > 500_000:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word string, h bigint, n bigint").groupBy("word", "h").agg(F.sum("n").alias("n"))


def count_vocabulary(docs: DataFrame) -> tuple[list[str], np.ndarray, DataFrame, list[int]]:
    """(vocabulary, counts by number, rest, sums): ``rest`` (h, n) counts the words beyond the vocabulary, ``sums``
    adds them up by bucket."""
    counted = saved(count_words(docs), "words")
    top = counted.orderBy(F.col("n").desc(), "word").limit(VOCABULARY).collect()
    rest = counted.where("false")
    if len(top) == VOCABULARY:
        rest = counted.where((F.col("n") < top[-1].n) | ((F.col("n") == top[-1].n) & (F.col("word") > top[-1].word)))
    rest, sums = rest.select("h", "n"), [0] * UNKNOWN
    for bucket, n in rest.groupBy(F.pmod("h", F.lit(UNKNOWN))).agg(F.sum("n")).collect():
        sums[bucket] = n
    counts = np.zeros(GAP)
    counts[: len(top)] = [r.n for r in top]
    counts[VOCABULARY:] = sums
    return [r.word for r in top], counts, rest, sums


def numbered(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(row, doc_id, ids, h, k), written once: the word numbers of each text, two bytes each, and the hashes and
    counts of its distinct words beyond the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, row = _Numbers(shared.value), TaskContext.get().partitionId() << 33
        for batch in _slices(batches):
            ids, h, k = zip(*[_numbered(x, numbers) for x in batch.column("text").to_pylist()])
            numbers.trim()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(ids)), pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(h, longs), pa.array(k, longs)], ["row", "doc_id", "ids", "h", "k"])
            row += len(ids)

    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "row bigint, doc_id bigint, ids binary, h array<bigint>, k array<bigint>"), "numbered")


def fit(table: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE, seed: int = 9) -> np.ndarray:
    """The weights of a network trained on the ids of ``table``."""
    flat = first_weights(counts, seed)
    for _ in range(rounds):
        shared = table.sparkSession.sparkContext.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value.copy()
            w, seen = unpack(own), 0
            g, sums = unpack(np.zeros_like(own)), unpack(np.full_like(own, 1e-3))
            phase = 0
            for batch in _slices(batches, 256):
                text, at, _ = _laid_out(batch.column("ids"))
                picked, phase = at[phase::stride], (phase - len(at)) % stride
                for i in range(0, len(picked), BATCH):
                    train_step(w, g, sums, text, picked[i : i + BATCH])
                seen += len(picked)
            parts = [own[i : i + PART] for i in range(0, len(own), PART)] if seen else []
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "task", "seen", "weights"])

        def average(key, rows):
            total, weight = 0.0, 0
            rows = rows.sort_by("task")  # one order of addition
            for seen, x in zip(rows.column("seen").to_pylist(), rows.column("weights").to_pylist()):
                total, weight = total + seen * np.frombuffer(x, np.float32).astype(np.float64), weight + seen
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})

        learned = table.select("ids").mapInArrow(learn, "part int, task int, seen bigint, weights binary")
        means = sorted(learned.groupBy("part").applyInArrow(average, "part int, weights binary").collect())
        if means:
            flat = np.concatenate([np.frombuffer(r.weights, np.float32) for r in means])
    return flat


def train(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, seed: int = 9) -> tuple[list[str], np.ndarray, DataFrame, list[int]]:
    """(vocabulary, weights, rest, sums) of a network trained on ``docs``; see ``count_vocabulary``."""
    vocabulary, counts, rest, sums = count_vocabulary(docs)
    return vocabulary, fit(numbered(docs, vocabulary), counts, rounds, stride, seed), rest, sums


def train_and_score(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, seed: int = 9) -> DataFrame:
    """``score(docs, train(docs))`` with the texts numbered once."""
    vocabulary, counts, rest, sums = count_vocabulary(docs)
    table = numbered(docs, vocabulary)
    return _scored(table, fit(table, counts, rounds, stride, seed), rest, sums)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, DataFrame, list[int]]) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) per row of ``docs`` (doc_id, text).

    A null or empty text has no word, a sum of 0 and a null mean.  Rows that repeat, and null ids, keep
    their rows; an empty table gives none.  In each bucket all words that training did not see count as one
    word that it saw once.
    """
    vocabulary, weights, rest, sums = model
    return _scored(numbered(docs, vocabulary), weights, rest, sums)


def _scored(table: DataFrame, weights: np.ndarray, rest: DataFrame, sums: list[int]) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = unpack(shared.value)
        for batch in _slices(batches):
            text, at, lengths = _laid_out(batch.column("ids"))
            p = log_probabilities(w, text, at)
            sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), p, len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(lengths), pa.array(sums)], ["row", "doc_id", "n_tokens", "sum"])

    scored = table.select("row", "doc_id", "ids").mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, sum double")
    rare = table.select("row", F.inline(F.arrays_zip("h", "k"))).join(rest, "h", "left")
    whole = F.element_at(F.array(*[F.lit(float(n + 1)) for n in sums]), (F.pmod("h", F.lit(UNKNOWN)) + 1).cast("int"))
    share = F.col("k") * F.log(F.coalesce("n", F.lit(1)) / whole)
    rare = rare.groupBy("row").agg(F.sum(share.cast("decimal(28,12)")).cast("double").alias("shares"))  # decimals: one sum in any order
    both = scored.select("row", "doc_id", "n_tokens", "sum").join(rare, "row", "left").withColumn("log_likelihood", F.col("sum") + F.coalesce("shares", F.lit(0.0)))
    return both.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
