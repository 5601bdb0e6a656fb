"""Removal of byte strings that start more than once, by a logarithmic family of sparse suffix arrays.

A text holds a suffix per byte, too many to sort at scale, so only suffixes at *places* are indexed: of
every ``LENGTH`` bytes in a row the place is the start of the ``KEY``-byte string with the smallest hash.
The choice depends on these bytes alone, so two equal strings of ``LENGTH`` bytes hold their places at the
same distance, and a match is never missed.  A suffix is known by a long whose order is that of its first
three bytes, then of a fingerprint of its first ``KEY`` bytes; equal ``KEY``-byte prefixes are neighbours,
which is all that a scan for long matches needs.

Batches of documents come one after the other (``SuffixFamily.add``).  A batch's suffix array (distinct
keys, sorted, bucketed by key) is merge-scanned against the arrays of the levels: sort-merge joins of
bucketed tables, without a shuffle.  Then it becomes a level; two levels of equal size are merged, so a
suffix is rewritten a logarithmic number of times.  The scans report the keys met more than once.

Places with a met key whose surroundings (all strings that have the place) are the same everywhere are
repeated as a whole.  Of the others, the distinct surroundings are fetched from one text each, and their
strings compared key by key; a key with more than ``wide`` surroundings is dealt out by string instead.
Strings are compared by 128 bits of two hashes.  Nothing is collected per key or per document beyond a
bounded group or the document's own length.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import dropped, saved
from tracewell.session import work_path

#: Bytes of a string that must not start twice, and of the prefix that a suffix is known by.
LENGTH, KEY = 200, 64
#: Batches that a corpus is dealt into.
BATCHES = 4
#: Surroundings of a key that one task compares; those of other keys are dealt out by string.
WIDE = 10_000
#: Bytes that are hashed at a time, and low bits of a number for places among them.
CHUNK, PLACE_BITS = 1 << 20, 28
U = np.uint64


@lru_cache(4)
def _hashing(which: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    random = np.random.Generator(np.random.PCG64(which))
    base = int(random.integers(1 << 60, 1 << 63)) * 2 + 1
    return random.integers(0, 1 << 64, 256, dtype=U), U(base), U(pow(base, -1, 1 << 64))


@lru_cache(4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in _hashing(which)[1:]:
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


class _Hashes:
    """Fingerprints of any substring of ``data``: polynomials over random codes, modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int = 1):
        size = 1 << max(16, (len(data) + 1).bit_length())
        power, self.inverse = _powers(which, size)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_hashing(which)[0][data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(U))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by running minima of blocks from both ends."""
    rows = np.concatenate([values, np.full(-len(values) % width, np.iinfo(U).max, U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    n = len(values) - width + 1
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def _places(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, key: int):
    """(row, first string, strings, place in them, key, surroundings) of the places in texts data[starts:stops]."""
    long = stops - starts >= length
    turn = np.zeros(len(data) + 1, np.int32)
    np.add.at(turn, starts[long], 1)
    np.add.at(turn, stops[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(turn))
    if not len(at):
        return None
    hashes = _Hashes(data)
    every = np.arange(len(data) - key + 1)
    fingerprint = hashes.of(every, every + key)
    ranked = (fingerprint >> U(PLACE_BITS) << U(PLACE_BITS)) | every.astype(U)
    place = (_sliding_least(ranked, length - key + 1)[at] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:] - 1, len(place) - 1]
    p, low, high = place[first], at[first], at[last]
    row = np.searchsorted(starts, low, side="right") - 1
    head = data[p].astype(U) << U(56) | data[p + 1].astype(U) << U(48) | data[p + 2].astype(U) << U(40)
    keys = ((head ^ U(1 << 63)) | (fingerprint[p] >> U(24))).view(np.int64)
    return row, low - starts[row], high - low + 1, p - low, keys, hashes.of(low, high + length).view(np.int64)


def _pieces(texts: pa.Array, length: int):
    """(data, row, offset in the text, starts, stops) for runs of texts of about CHUNK bytes; a longer text
    comes in parts that share ``length - 1`` bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin, end = offsets[:-1], offsets[1:]
    parts = np.maximum(1, -(-(end - begin - length + 1) // CHUNK))
    row = np.repeat(np.arange(len(texts)), parts)
    skip = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
    begin, end = begin[row] + skip, np.minimum(end[row], begin[row] + skip + CHUNK + length - 1)
    group = begin // CHUNK
    for g in np.split(np.arange(len(row)), np.flatnonzero(np.diff(group)) + 1):
        if len(g):
            low, high = begin[g[0]], end[g].max()
            yield data[low:high], row[g], skip[g], begin[g] - low, end[g] - low


def text_ref(text: Column) -> list[Column]:
    """Two numbers, of 64 and 15 bits, that stand for a text (null is empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("ref"), F.xxhash64(F.lit(7), text).bitwiseAND(32767).alias("ref2")]


#: What a row of a place holds in one long: where its first string starts (32 bits), how many strings it has and
#: how far the place is from the first (8 bits each), whether the text has copies (1), the text's second number (15).
FROM, COUNT, COPIED, REF2 = "(at & 4294967295)", "(shiftright(at, 32) & 255)", "(shiftright(at, 48) & 1)", "(shiftright(at, 49) & 32767)"


def _index_places(texts: DataFrame, length: int, key: int) -> DataFrame:
    """(key, around, ref, at) of ``texts`` (ref, ref2, copied, text)."""

    def run(batches):
        for b in batches:
            ref, tail = b.column("ref").to_numpy(), b.column("ref2").to_numpy() << 49 | b.column("copied").to_numpy() << 48
            for data, row, skip, starts, stops in _pieces(b.column("text"), length):
                found = _places(data, starts, stops, length, key)
                if found:
                    i, first, count, place, keys, around = found
                    at = first + skip[i] | count << 32 | place << 40 | tail[row[i]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, around, ref[row[i]], at)], ["key", "around", "ref", "at"])

    return texts.select("ref", "ref2", F.col("copied").cast("long").alias("copied"), "text").mapInArrow(run, "key long, around long, ref long, at long")


class SuffixFamily:
    """Levels of suffix arrays, the newest last; each twice the size of the next or more.

    ``add`` takes the places of a batch (``key``, ``around``, ``at``) and returns the keys that the batch
    meets again, in itself or in a level: (key, n, mixed), where ``n`` counts its places so far and
    ``mixed`` says that their surroundings differ.  ``levels`` holds (batches, table, folder).
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _store(self, array: DataFrame) -> tuple[str, str]:
        name, folder = f"suffixes_{uuid.uuid4().hex}", work_path(self.spark, "suffixes")
        array.write.bucketBy(self.buckets, "key").sortBy("key").option("path", folder).saveAsTable(name)
        return name, folder

    def _drop(self, level: tuple) -> None:
        self.spark.sql(f"DROP TABLE {level[1]}")
        dropped(self.spark, level[2])

    def _compact(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            b, a = self.levels.pop(), self.levels.pop()
            both = self.spark.table(a[1]).alias("a").join(self.spark.table(b[1]).alias("b"), F.col("a.key") == F.col("b.key"), "full_outer")
            other = F.coalesce(F.col("a.around") != F.col("b.around"), F.lit(False))
            mixed = F.coalesce("a.mixed", F.lit(False)) | F.coalesce("b.mixed", F.lit(False)) | other
            count = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
            merged = both.select(F.coalesce("a.key", "b.key").alias("key"), F.coalesce("a.around", "b.around").alias("around"), count.alias("n"), mixed.alias("mixed"))
            self.levels.append((a[0] + b[0], *self._store(merged)))
            self._drop(a)
            self._drop(b)

    def add(self, places: DataFrame) -> DataFrame:
        self._compact()
        own = places.groupBy("key").agg(F.min("around").alias("around"), F.expr(f"sum(1 + {COPIED}) AS n"), (F.min("around") != F.max("around")).alias("mixed"))
        name, folder = self._store(own.repartition(self.buckets, "key"))
        met = self.spark.table(name)
        for _, level, _ in self.levels:
            old = self.spark.table(level).select("key", F.col("around").alias("around_"), F.col("n").alias("n_"), F.col("mixed").alias("mixed_"))
            mixed = F.col("mixed") | F.coalesce(F.col("mixed_") | (F.col("around") != F.col("around_")), F.lit(False))
            met = met.join(old, "key", "left").select("key", "around", (F.col("n") + F.coalesce("n_", F.lit(0))).alias("n"), mixed.alias("mixed"))
        met = saved(met.where("n > 1").select("key", "n", "mixed"), "met")
        self.levels.append((1, name, folder))
        return met

    def close(self) -> None:
        while self.levels:
            self._drop(self.levels.pop())


def _join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], share: int) -> DataFrame:
    """``rows`` joined with ``counted``, unique by ``keys`` with the number ``n`` of their rows: keys of more than
    ``share`` rows, a bounded number, are broadcast, so none of them is one task's."""
    often = F.broadcast(counted.where(F.col("n") > share))
    seldom = rows.join(often.select(*keys), keys, "left_anti").join(counted.where(F.col("n") <= share), keys)
    return rows.join(often, keys).unionByName(seldom)


def _strings(texts: DataFrame, wanted: DataFrame, length: int, key: int) -> DataFrame:
    """(key, ref, at, wide, bytes): the surroundings named in ``wanted`` (ref, at, wide), cut from their texts."""
    asked = wanted.groupBy("ref", F.expr(f"{REF2} AS ref2")).agg(F.collect_list(F.struct("at", "wide")).alias("asked"))

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for ref, text, asked in zip(b.column("ref").to_pylist(), b.column("text"), b.column("asked").to_pylist()):
                text = np.frombuffer(text.as_buffer(), np.uint8)
                at = np.array([x["at"] for x in asked], np.int64)
                first, count, place = at & 0xFFFFFFFF, at >> 32 & 255, at >> 40 & 255
                cut = [text[f : f + n].tobytes() for f, n in zip(first.tolist(), (count + length - 1).tolist())]
                starts = np.cumsum([0] + [len(x) for x in cut[:-1]])
                own = _Hashes(np.frombuffer(b"".join(cut), np.uint8)).of(starts + place, starts + place + key)
                for column, values in zip(out, (own.view(np.int64).tolist(), [ref] * len(at), at.tolist(), [x["wide"] for x in asked], cut)):
                    column.extend(values)
                if len(out[0]) >= 4096:
                    yield _batch(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _batch(out)

    def _batch(out):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["key", "ref", "at", "wide", "bytes"])

    schema = "key long, ref long, at long, wide boolean, bytes binary"
    return texts.select("ref", "ref2", "text").join(asked, ["ref", "ref2"]).select("ref", "text", "asked").mapInArrow(run, schema)


def _string_hashes(cut: list[bytes], at: np.ndarray, length: int):
    """Two hashes of every string in the surroundings ``cut``, with the row and number of each."""
    count = at >> 32 & 255
    starts = np.cumsum([0] + [len(x) for x in cut[:-1]])
    row = np.repeat(np.arange(len(at)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    data, begin = np.frombuffer(b"".join(cut), np.uint8), starts[row] + nth
    return _Hashes(data, 1).of(begin, begin + length), _Hashes(data, 2).of(begin, begin + length), row, nth


def _repeated_in_keys(cut: DataFrame, length: int) -> DataFrame:
    """(ref, at, low, high): the first and last string of each row that another row of its key holds too."""

    def resolve(keys, refs, ats, cuts):
        one, two, row, nth = _string_hashes(cuts, ats, length)
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        row, nth = row[twice], nth[twice]
        hit, first = np.unique(row, return_index=True)
        low, high = (np.minimum.reduceat(nth, first), np.maximum.reduceat(nth, first)) if len(hit) else (nth, nth)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (refs[hit], ats[hit], low, high)], ["ref", "at", "low", "high"])

    def run(batches):
        held = [np.empty(0, np.int64)] * 3 + [[]]
        for b in batches:
            new = [b.column(c).to_numpy() for c in ("key", "ref", "at")]
            held = [np.concatenate([h, n]) for h, n in zip(held, new)] + [held[3] + b.column("bytes").to_pylist()]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done >= 4096:  # whole keys only; the last key may go on
                yield resolve(*[x[:done] for x in held])
                held = [x[done:] for x in held]
        if len(held[0]):
            yield resolve(*held)

    own = cut.where("NOT wide").select("key", "ref", "at", "bytes")
    return own.repartition("key").sortWithinPartitions("key").mapInArrow(run, "ref long, at long, low long, high long")


def _repeated_in_wide_keys(cut: DataFrame, length: int, share: int) -> DataFrame:
    """As ``_repeated_in_keys`` for the keys with too many surroundings for one task: a row per string."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                ats = part.column("at").to_numpy()
                one, two, row, nth = _string_hashes(part.column("bytes").to_pylist(), ats, length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one.view(np.int64), two.view(np.int64), part.column("ref").to_numpy()[row], ats[row], nth)], ["one", "two", "ref", "at", "nth"])

    strings = saved(cut.where("wide").select("ref", "at", "bytes").mapInArrow(run, "one long, two long, ref long, at long, nth long"), "strings")
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
    return _join_counted(strings, saved(twice, "twice"), ["one", "two"], share).groupBy("ref", "at").agg(F.min("nth").alias("low"), F.max("nth").alias("high"))


def repeated_spans(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH, key: int = KEY, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """(copied, spans): texts (ref, ref2) that several rows hold, and the ``spans`` (array of start, stop in bytes,
    sorted, apart) of every other text's bytes that a repeated string covers.  ``docs`` holds ref, ref2, id and text."""
    spark = docs.sparkSession
    copied = saved(docs.groupBy("ref", "ref2").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "copied")
    # of copies one goes on, marked as such
    texts = docs.join(copied, ["ref", "ref2"], "left").where("n IS NULL OR id = least").select("ref", "ref2", F.col("n").isNotNull().alias("copied"), "text")
    places = saved(_index_places(texts, length, key), "places")
    family = SuffixFamily(spark)
    met = [family.add(places.where(F.pmod("ref", F.lit(batches)) == i)) for i in range(batches)]
    family.close()
    met = [m.select("key", "n", "mixed") for m in met]
    keys = met[0]
    for m in met[1:]:
        keys = keys.unionByName(m)
    # the last batch that met a key has counted all of its places
    keys = saved(keys.groupBy("key").agg(F.max("n").alias("n"), F.max("mixed").alias("mixed")), "keys")
    share = max(1000, places.count() // 1000)
    again = saved(_join_counted(places, keys, ["key"], share).select("key", "around", "ref", "at", "mixed"), "again")
    whole = again.where(~F.col("mixed")).select("ref", "at", F.lit(0).alias("low"), F.expr(f"{COUNT} - 1 AS high"))

    mixed = again.where("mixed")
    around = saved(mixed.groupBy("key", "around").agg(F.expr(f"sum(1 + {COPIED}) AS n"), F.min(F.struct("ref", "at")).alias("one")), "around")
    equal = _join_counted(mixed.select("key", "around", "ref", "at"), around.where("n > 1").select("key", "around", "n"), ["key", "around"], share)
    equal = equal.select("ref", "at", F.lit(0).alias("low"), F.expr(f"{COUNT} - 1 AS high"))
    many = saved(around.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > wide).select("key", F.lit(True).alias("wide")), "wide")
    wanted = saved(around.join(many, "key", "left").select("one.ref", "one.at", F.coalesce("wide", F.lit(False)).alias("wide")), "wanted")
    cut = saved(_strings(texts, wanted, length, key), "cut")
    parts = _repeated_in_keys(cut, length)
    if not many.isEmpty():
        parts = parts.unionByName(_repeated_in_wide_keys(cut, length, share))

    covered = whole.unionByName(equal).unionByName(parts).where(f"{COPIED} = 0")
    covered = covered.select("ref", F.expr(f"{REF2} AS ref2"), F.expr(f"{FROM} + low AS start"), F.expr(f"{FROM} + high + {length} AS stop"))
    return copied, saved(_joined_up(covered), "spans")


def _joined_up(covered: DataFrame) -> DataFrame:
    """Spans of each text, those that overlap or touch as one."""
    text = Window.partitionBy("ref", "ref2").orderBy("start", "stop")
    before = F.max("stop").over(text.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") > F.col("before"), 1).otherwise(0)).over(text.rowsBetween(Window.unboundedPreceding, 0))
    runs = covered.withColumn("before", before).withColumn("run", run).groupBy("ref", "ref2", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy("ref", "ref2").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH, key: int = KEY, wide: int = WIDE) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs`` (doc_id, text; other columns are left out).

    ``spans`` are the maximal runs (start, stop) of UTF-8 bytes covered by a string of ``length`` bytes that
    also starts elsewhere, in the same text or another one; ``kept`` is the rest, joined.  A null text is
    empty and keeps nothing; rows that repeat are copies of each other; a null id is an id like others;
    texts below ``length`` bytes lose nothing; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.coalesce("text", F.lit("")).alias("text"), *text_ref(F.col("text")))
    copied, spans = repeated_spans(docs, batches, length, key, wide)
    rows = docs.join(copied.select("ref", "ref2", F.lit(True).alias("copied")), ["ref", "ref2"], "left").join(spans, ["ref", "ref2"], "left").select("doc_id", "text", "copied", "spans")
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"

    def run(found):
        for b in found:
            out = [[], [], [], []]
            for doc_id, text, copy, cut in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("copied").to_pylist(), b.column("spans").to_pylist()):
                text = text.encode()
                cut = ([{"start": 0, "stop": len(text)}] if len(text) >= length else []) if copy else cut or []
                edges = [0, *[e for s in cut for e in (s["start"], s["stop"])], len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
                for column, value in zip(out, (doc_id, len(text), cut, kept)):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, schema)
