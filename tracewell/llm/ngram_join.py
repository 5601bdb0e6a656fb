"""Self-join of documents by the Jaccard similarity of their word n-grams, by rare-first prefix filtering.

1. One scan gives every document's number of n-grams, a signature and a parity bitmap of the set, and a
   sketch: how often the n-grams of each of ``SKETCH`` hash slots occur in the whole corpus.  The sketch has a
   fixed size (4 MB); it only orders n-grams, rare slots first, and any fixed order gives the same links.
2. A second scan emits each distinct set's prefix: as many of its rarest n-grams as two linked sets cannot
   avoid sharing.  The prefixes are dealt out by n-gram and sorted by set size.
3. In each n-gram's list every set is compared with a leader only (the smallest set, then the next one whose
   size the leader cannot reach).  A list whose members are all linked with one leader lies within one
   component and is done.  So a group of copies costs its size, not its square.
4. A list of three or more sets of which not all are linked with the leader stays open.  In rounds, its sets
   outside the list's main component are compared with a few more sets of that component (``ROUNDS``).
5. Then all pairs of an open list's sets that are still in different components are joined under the length,
   prefix, positional and bitmap filters and the triangle inequality of the Jaccard distance by way of the
   leader, and each distinct pair is verified once.

Pairs meet the bitmap filter before any text moves: two sets differ in at least as many n-grams as their
bitmaps differ in bits, so a pair whose bitmaps are too far apart is not linked.  A bitmap has at least a bit
for each n-gram, a small part of the text.  Only the texts of pairs that are left are read and shuffled, in
proportion to the near copies and not to the pairs that share a frequent n-gram.

Verification then applies the suffix filter (a bound from splitting both sorted sets at common pivots),
then intersects the whole sets; with leaders it always intersects, as the triangle inequality needs the
distance itself and not a bound on it.  N-grams are 64-bit hashes; sets are told apart by a 64-bit signature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import components, first_k, saved

#: Slots of the frequency sketch, and slots to a row on its way.
SKETCH, ROW = 1 << 20, 1 << 14
#: Documents in a slot of the sketch from which an n-gram's list is cut in parts of about as many.
HOT_LIST = 1 << 16
#: Partners of one leader to a verifying task's group, and by round the further leaders of an open list.
GROUP, ROUNDS = 256, (4, 16)
#: Bits that mark the documents to be verified (4 MB), and bits to a row on their way.
MARKS, MARK_ROW = 1 << 25, 1 << 15
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """Hashes of words; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def ngram_set(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text; of a shorter one, its whole sequence; else empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ w[j : len(w) - n + 1 + j]) * _ODD
        h ^= h >> np.uint64(29)
    h = h * _MIX
    return np.unique(h ^ (h >> np.uint64(32)))


def _signature(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(grams.tobytes()))))


def _bitmap(grams: np.ndarray) -> np.ndarray:
    """For each of a power of two of slots, whether an odd number of the set's n-grams falls into it; as longs."""
    slots = max(64, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(a: Column, b: Column) -> Column:
    """The number of bits in which two bitmaps differ, the longer one folded: at most the sets' symmetric difference."""
    n = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        fold = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(i, F.size(x) - 1, n), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(x, j))))
        return F.when(F.size(x) == n, x).otherwise(fold)

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _may_link(size_a: Column, bits_a: Column, size_b: Column, bits_b: Column, num: int, den: int) -> Column:
    """False only if the bitmaps show that the sets' similarity is below num / den."""
    both = (size_a + size_b).cast("long")
    return (num + den) * (both - _apart(bits_a, bits_b)) >= 2 * num * both


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Small slices with their texts, so that memory follows the slice and not the batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, part.column("text").to_pylist()


def sets_and_sketch(docs: DataFrame, n: int = 5) -> DataFrame:
    """A row per document (doc_id, sig, size, bits) and, per task, rows of the sketch (slot_row, counts)."""
    names, longs = ["doc_id", "sig", "size", "bits", "slot_row", "counts"], pa.list_(pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _WordHashes(), np.zeros(SKETCH, np.uint32)
        for part, texts in _texts(batches):
            sets = [ngram_set(x, n, hashes) for x in texts]
            np.add.at(counts, (np.concatenate(sets) >> np.uint64(44)).astype(np.int64), np.uint32(1))
            k = len(sets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_signature(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([_bitmap(x) for x in sets], longs), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        rows = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(counts.reshape(-1, ROW)) if part.any()]
        k = len(rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, longs), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id bigint, sig bigint, size int, bits array<bigint>, slot_row int, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The summed sketch, 4 MB whatever the input."""

    def add(key, parts):
        total = np.zeros(ROW, np.uint64)
        for part in parts.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(part), np.uint32)
        total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
        return pa.table({"slot_row": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    counts = np.zeros((SKETCH // ROW, ROW), np.uint32)
    summed = rows.where("slot_row is not null").select("slot_row", "counts").groupBy("slot_row").applyInArrow(add, "slot_row int, counts binary")
    for i, part in summed.collect():
        counts[i] = np.frombuffer(zlib.decompress(part), np.uint32)
    return counts.reshape(-1)


def _prefixes(docs: DataFrame, counts, n: int, num: int, den: int, hot: int) -> DataFrame:
    """(gram, part, sig, size, pos) for the prefix of every set, each set once per task; part is -1 unless the gram is hot."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order, seen = _WordHashes(), counts.value, set()
        for _, texts in _texts(batches):
            found = []
            for text in texts:
                x = ngram_set(text, n, hashes)
                size = len(x)
                if not size or (sig := _signature(x)) in seen:
                    continue
                seen.add(sig)
                often = order[(x >> np.uint64(44)).astype(np.int64)]
                take = size - (num * size + den - 1) // den + 1
                at = np.lexsort((x, often))[:take]
                parts = (often[at] // np.uint32(hot)).astype(np.int64)
                part = np.where(parts > 0, (sig & (2**62 - 1)) % (parts + 1), -1).astype(np.int32)
                found.append((x[at].view(np.int64), part, np.full(take, sig, np.int64), np.full(take, size, np.int32), np.arange(take, dtype=np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["gram", "part", "sig", "size", "pos"])

    return docs.select("text").mapInArrow(emit, "gram bigint, part int, sig bigint, size int, pos int")


def _lists(prefixes: DataFrame, num: int, den: int, long: int = 3) -> DataFrame:
    """Lists of two sets or more, each row with its leader; ``more`` marks the rows of later leaders, ``three`` lists of ``long`` sets or more.

    Rows come sorted by gram, part and size and are streamed.  The one list that goes on in the next batch
    is held; parts keep a list at about ``HOT_LIST`` sets.  A part of a hot gram is kept even if it has one set.
    """
    names = ["gram", "part", "sig", "size", "pos", "leader", "more", "three"]

    def led(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        gram, part, sig, size, pos = cols
        new = np.append(True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(gram))
        keep = np.repeat((ends - starts > 1) | (part[starts] >= 0), ends - starts)
        at = np.repeat(starts, ends - starts)
        later = np.zeros(len(gram), bool)
        for k in np.flatnonzero(num * size[ends - 1].astype(np.int64) > den * size[starts].astype(np.int64)):
            reach = starts[k]
            for i in range(starts[k], ends[k]):  # a leader leads until the sizes pass its reach
                if num * int(size[i]) > den * int(size[reach]):
                    reach = i
                at[i] = reach
            later[starts[k] : ends[k]] = at[starts[k] : ends[k]] != starts[k]
        three = np.repeat((ends - starts >= long) | (part[starts] >= 0), ends - starts)
        cols = [c[keep] for c in (gram, part, sig, size, pos, sig[at], later, three)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names) if keep.any() else None

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            gram, part, sig = cols[:3]
            copy = (gram[1:] == gram[:-1]) & (part[1:] == part[:-1]) & (sig[1:] == sig[:-1])  # sent by several tasks
            cols = [c[np.append(True, ~copy)] for c in cols]
            gram, part = cols[:2]
            rest = np.flatnonzero((gram != gram[-1]) | (part != part[-1]))
            cut = rest[-1] + 1 if len(rest) else 0
            held = [c[cut:] for c in cols]
            if cut and (out := led([c[:cut] for c in cols])):
                yield out
        if held and (out := led(held)):
            yield out

    schema = "gram bigint, part int, sig bigint, size int, pos int, leader bigint, more boolean, three boolean"
    return prefixes.repartition("gram", "part").sortWithinPartitions("gram", "part", "size", "sig").mapInArrow(lead, schema)


def _suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """A lower bound on the symmetric difference of two sorted sets, from their parts on both sides of common pivots."""
    if not depth or len(x) < 2 or len(y) < 2:
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    return _suffix_bound(x[:i], y[:j], depth - 1) + _suffix_bound(x[i:], y[j:], depth - 1)


def _near_pairs(pairs: DataFrame, reps: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The distinct ``pairs`` (leader, sig) that pass the bitmap filter, with the ``rep`` of both; written once."""
    side = lambda key, x: reps.select(F.col("sig").alias(key), F.col("rep").alias(f"{x}_rep"), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits"))
    both = pairs.distinct().join(side("leader", "a"), "leader").join(side("sig", "b"), "sig")
    near = both.where(_may_link(F.col("a_size"), F.col("a_bits"), F.col("b_size"), F.col("b_bits"), num, den))
    return saved(near.select("leader", "sig", "a_rep", "b_rep"), name)


def _marked(reps: DataFrame) -> np.ndarray:
    """A bit for each of ``MARKS`` hash slots that one of ``reps`` (slot) falls into, 4 MB whatever the input."""

    def pack(key, rows):
        bits = np.zeros(MARK_ROW, np.uint8)
        bits[rows.column("slot").to_numpy() % MARK_ROW] = 1
        return pa.table({"mark_row": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

    marks = np.zeros((MARKS // MARK_ROW, MARK_ROW // 8), np.uint8)
    rows = reps.distinct().withColumn("mark_row", F.floor(F.col("slot") / MARK_ROW).cast("long"))
    for i, part in rows.groupBy("mark_row").applyInArrow(pack, "mark_row bigint, bits binary").collect():
        marks[i] = np.frombuffer(zlib.decompress(part), np.uint8)
    return marks.reshape(-1)


def _texts_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep, ...) with the texts of the documents ``rep``; other documents are left out before the shuffle, but for those that share a mark."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(MARKS)).alias("slot")
    marks = docs.sparkSession.sparkContext.broadcast(_marked(wanted.select(slot)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.select(["rep", "text"]).filter(pa.array((marks.value[at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0))

    own = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rep"), "text").select("rep", "text", slot)
    return own.mapInArrow(keep, "rep bigint, text string").join(wanted, "rep")


def _verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int, exact: bool = False) -> DataFrame:
    """``pairs`` (leader, sig, a_rep, b_rep) with the sizes of both sets, their overlap (unless ``exact``, perhaps an upper bound on it) and ``linked``.

    The texts of the partners go to their leader, in groups of about ``GROUP`` partners; the leader's text
    goes to each of these.
    """
    schema = "leader bigint, sig bigint, size_a int, size_b int, overlap int, linked boolean"
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    groups = pairs.groupBy("leader", "a_rep").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    salted = pairs.join(groups.drop("a_rep"), "leader").withColumn("salt", F.pmod(F.xxhash64("sig"), F.col("groups")).cast("int"))
    wanted = salted.select("leader", "salt", F.lit(1).alias("role"), "sig", F.col("b_rep").alias("rep"))
    wanted = wanted.union(groups.select("leader", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)), F.lit(0), "leader", "a_rep"))
    given = _texts_for(docs, saved(wanted, "wanted")).select("leader", "salt", "role", "sig", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, first = _WordHashes(), None, None
        for part, texts in _texts(batches):
            out = []
            for leader, salt, role, sig, text in zip(*[part.column(c).to_pylist() for c in ("leader", "salt", "role", "sig")], texts):
                x = ngram_set(text, n, hashes)
                if _signature(x) != sig:  # another row with this id
                    continue
                if not role:
                    key, first = (leader, salt), x
                    continue
                assert key == (leader, salt)
                most = (len(x) + len(first) - _suffix_bound(first, x)) // 2
                if exact or (num + den) * most >= num * (len(x) + len(first)):
                    most = len(np.intersect1d(first, x, assume_unique=True))
                out.append((leader, sig, len(first), len(x), most, (num + den) * most >= num * (len(x) + len(first))))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["leader", "sig", "size_a", "size_b", "overlap", "linked"])

    done = given.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role", "sig")
    return saved(done.mapInArrow(compare, schema).distinct(), "verified")


def _distance() -> Column:
    return 1 - F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))


def link_documents(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, hot: int = HOT_LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text), linked at a Jaccard similarity of num / den.

    Words are lower-cased in A-Z and split at ASCII white space.  A text of fewer than ``n`` words is one
    n-gram; a null or empty one has none and links with nothing.  Rows with a null id take part; they are
    never the smallest id of a component, whose id is null only if all its rows' are.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    scanned = saved(sets_and_sketch(docs, n), "sets")
    sets = scanned.where("sig is not null").select("doc_id", "sig", "size")
    counts = spark.sparkContext.broadcast(_sketch(scanned))
    reps = scanned.where("size > 0").groupBy("sig").agg(F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("rep"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    reps = saved(reps, "reps")

    lists = saved(_lists(_prefixes(docs, counts, n, num, den, hot), num, den), "lists")
    leaders = lists.where("part >= 0 and sig = leader").select("gram", F.lit(-1).alias("part"), "sig", "size", "pos")
    # a list of two sets has no further pair to look for, but behind two leaders stand the sets of their parts
    lists = lists.union(saved(_lists(leaders, num, den, long=2), "leaders"))
    stars = _verified(docs, _near_pairs(lists.where("sig <> leader").select("leader", "sig"), reps, num, den, "stars"), n, num, den, exact=True)
    links = stars.where("linked").select(F.col("leader").alias("a"), F.col("sig").alias("b"))
    member = saved(components(links), "member")

    state = lists.where("three").join(stars.select("leader", "sig", "linked", _distance().alias("far")), ["leader", "sig"], "left")
    state = saved(state.select("gram", "sig", "size", "pos", "leader", F.when(F.col("leader") == F.col("sig"), 0.0).otherwise(F.col("far")).alias("far"), (F.col("more") | ((F.col("leader") != F.col("sig")) & ~F.coalesce("linked", F.lit(False)))).alias("open")), "state")
    rows = state.join(state.where("open").select("gram").distinct(), "gram", "left_semi")
    rows = rows.join(member.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("component", "sig"))
    rows = saved(rows.select("gram", "sig", "size", "pos", "comp", "leader", "far").distinct(), "rows")
    for k, leading in enumerate(ROUNDS):
        main = rows.groupBy("gram", "comp").count().groupBy("gram").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        marked = saved(rows.join(main, "gram").select("gram", "sig", "size", (F.col("comp") != F.col("main")).alias("odd")), "marked")
        inside = marked.where("not odd").join(marked.where("odd").select("gram").distinct(), "gram", "left_semi")
        by = first_k(inside, "gram", [F.xxhash64(F.lit(k), "sig"), F.col("sig")], leading, "nth").select("gram", F.col("sig").alias("leader"), F.col("size").alias("leader_size"))
        odd = marked.where("odd").join(by, "gram").select("leader", "sig", F.least("size", "leader_size").alias("least"), F.greatest("size", "leader_size").alias("most"))
        odd = odd.where(den * F.col("least").cast("long") >= num * F.col("most")).select("leader", "sig")
        new = _verified(docs, _near_pairs(odd, reps, num, den, "round"), n, num, den)
        member = saved(components(member.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new.where("linked").select("leader", "sig"))), "member")
        now = rows.drop("comp").join(member.withColumnRenamed("node", "sig"), "sig", "left")
        rows = saved(now.select("gram", "sig", "size", "pos", F.coalesce("component", "sig").alias("comp"), "leader", "far"), "rows")
    main = rows.groupBy("gram", "comp").count().groupBy("gram").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    odd = saved(rows.join(main, "gram").where("comp <> main"), "odd")
    bits = reps.select("sig", "bits")
    a = odd.join(bits, "sig").alias("a")
    b = rows.join(odd.select("gram").distinct(), "gram", "left_semi").join(bits, "sig").alias("b")
    larger, smaller = F.greatest("a.size", "b.size").cast("long"), F.least("a.size", "b.size").cast("long")
    both = larger + smaller
    # the smaller set shares the gram within its shorter indexing prefix
    index_pos = F.when((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.sig") < F.col("b.sig"))), F.col("a.pos")).otherwise(F.col("b.pos"))
    index_size = smaller - F.ceil(2 * num * smaller / (num + den)) + 1
    most = 1 + F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos")) - 1
    near = F.coalesce((F.col("a.leader") != F.col("b.leader")) | (F.abs(F.col("a.far") - F.col("b.far")) <= 1 - num / den + 1e-9), F.lit(True))
    pairs = a.join(b, F.col("a.gram") == F.col("b.gram")).where(
        (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("a.main")) | (F.col("a.sig") < F.col("b.sig")))
        & (den * smaller >= num * larger) & (index_pos < index_size) & ((num + den) * most >= num * both) & near
        & _may_link(F.col("a.size"), F.col("a.bits"), F.col("b.size"), F.col("b.bits"), num, den)
    )
    pairs = pairs.select(F.least("a.sig", "b.sig").alias("leader"), F.greatest("a.sig", "b.sig").alias("sig"))
    more = _verified(docs, _near_pairs(pairs, reps, num, den, "pairs"), n, num, den).where("linked")
    member = components(member.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("leader", "sig")))

    groups = reps.select("sig", "rep").join(member.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("component", "sig").alias("comp"))
    least = groups.groupBy("comp").agg(F.min("rep").alias("least"))
    of_set = groups.join(least, "comp").select("sig", F.when(F.col("least") < 2**63 - 1, F.col("least")).alias("least"))
    found = sets.join(of_set, "sig", "left")
    return found.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
