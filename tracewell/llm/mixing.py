"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame code only.

The documents of a source, in a fixed random order, form one stream of words, cut into blocks of
``block_words``.  A source whose target is above its size is taken in up to ``max_repeats`` passes.  The
quotas (blocks to take from each source) stand at the root of a binary tree over the output shards; each
node splits its quotas exactly between its two halves by multivariate-hypergeometric draws, so every shard
is as mixed as if all blocks had been shuffled, while only (source, shard) counts are handled.  Each shard
then draws its own range of the source's permuted blocks, and orders what it drew by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, saved, word_count

#: Leading hexadecimal digits of the order key that cut a source's stream into slices for running sums.
SLICE_DIGITS = 3
#: Primes for permuting block numbers; one that does not divide the number of blocks is used.
PRIMES = [2147483647, 1640531527, 1327217909, 1000000007]


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, share: float = 1.0) -> DataFrame:
    """``sizes`` (source, size) with ``target``: by weight, none above ``max_repeats`` times the source's size.

    Sources in code point order, null last, weigh ``weights`` in turn.  What the limit cuts off is shared by
    weight among the others until none is above: sources are filled in order of limit over weight.  The
    table has a row per source, as a configuration of weights has, so its windows are small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    t = sizes.withColumn("nth", F.row_number().over(order) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    t = t.withColumn("most", F.col("size") * F.lit(float(max_repeats))).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("total", F.sum("size").over(every) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(every))
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    t = t.withColumn("level", left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level at the first source that it does not fill; further down it falls, as sources count as filled that are not
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    t = t.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))))
    return t.select("source", "nth", F.col("size").alias("source_size"), "weight", "target")


def _uniform(*seed: Column | str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*seed), 11).cast("double") + 0.5) / float(2**53)


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """A draw by inversion: how many of ``draws`` out of ``total`` are among the ``good``.

    The support is walked from the mode upwards and then downwards with weights relative to the mode's, out
    to 12 standard deviations plus 40 (the rest weighs less than a double can tell), once for the sum and
    once for the place where ``u`` falls.
    """
    lo, hi = F.greatest(F.lit(0), draws - (total - good)), F.least(good, draws)
    mode = F.greatest(lo, F.least(hi, F.floor((draws + 1.0) * (good + 1.0) / (total + 2.0))))
    n, p = draws.cast("double"), good / total
    wide = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), n * p * (1 - p) * (total - draws) / F.greatest(total - 1, F.lit(1))))) + 40
    case = F.struct(*[c.cast("long").alias(k) for c, k in ((good, "g"), (total, "t"), (draws, "n"), (mode, "m"), (F.least(hi, mode + wide) - mode, "up"), (mode - F.greatest(lo, mode - wide), "down"))])

    def walk(c, first, step):
        def weight(acc, i):
            up = i <= c["up"]
            k = F.when(up, c["m"] + i).otherwise(c["m"] - (i - c["up"]))
            rise = (c["g"] - k + 1.0) * (c["n"] - k + 1.0) / (k * (c["t"] - c["g"] - c["n"] + k * 1.0))
            fall = (k + 1.0) * (c["t"] - c["g"] - c["n"] + k + 1.0) / ((c["g"] - k) * (c["n"] - k * 1.0))
            w = F.when(i == 0, F.lit(1.0)).when(up, acc["w"] * rise).otherwise(F.when(i == c["up"] + 1, F.lit(1.0)).otherwise(acc["w"]) * fall)
            return k, w

        return F.aggregate(F.sequence(F.lit(0).cast("long"), c["up"] + c["down"]), first, lambda acc, i: step(acc, *weight(acc, i)))

    def draw(c):
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"))
        whole = walk(c, start, lambda acc, k, w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum")))["sum"] * u
        start = lambda x: F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"), x.alias("at"))
        pick = lambda acc, k, w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), F.when(acc["k"] >= 0, acc["k"]).when(acc["sum"] + w >= acc["at"], k).otherwise(acc["k"]).alias("k"), acc["at"].alias("at"))
        found = F.transform(F.array(whole), lambda x: walk(c, start(x), pick)["k"])[0]
        return F.when(found >= 0, found).otherwise(c["m"])

    return F.transform(F.array(case), draw)[0]


def shard_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Blocks of every source for each of ``2 ** levels`` shards: (nth, shard, start, blocks).

    ``quotas`` (nth, blocks) is the root.  A node's halves get half of its blocks each, drawn without
    replacement source by source; nothing is lost or made.
    """
    sources = F.array_sort(F.collect_list(F.struct("nth", "blocks")))
    tree = quotas.groupBy().agg(sources.alias("q")).select(F.lit(0).alias("node"), "q")
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        state = F.struct(total.alias("rest"), F.floor((total + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node"), F.lit(2))) / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("left"))

        def split(acc, x):
            k = F.when(x["blocks"] > 0, _hypergeometric(x["blocks"], acc["rest"], acc["draws"], _uniform(F.lit(seed), F.lit(level), "node", x["nth"]))).otherwise(F.lit(0).cast("long"))
            return F.transform(F.array(k), lambda v: F.struct((acc["rest"] - x["blocks"]).alias("rest"), (acc["draws"] - v).alias("draws"), F.concat(acc["left"], F.array(v)).alias("left")))[0]

        tree = saved(tree.withColumn("left", F.aggregate("q", state, split)["left"]), "splits")
        half = F.zip_with("q", "left", lambda x, v: F.struct(x["nth"].alias("nth"), v.alias("blocks")))
        rest = F.zip_with("q", "left", lambda x, v: F.struct(x["nth"].alias("nth"), (x["blocks"] - v).alias("blocks")))
        tree = tree.select("node", F.posexplode(F.array(half, rest)).alias("side", "q")).select((F.col("node") * 2 + F.col("side")).alias("node"), "q")
    leaves = tree.select(F.col("node").alias("shard"), F.inline("q"))
    ends = F.sum("blocks").over(Window.partitionBy("nth").orderBy("shard"))
    return leaves.select("nth", "shard", (ends - F.col("blocks")).alias("start"), "blocks")


def _permuted(i: Column, n: Column, seed: Column) -> Column:
    """A permutation of 0 .. n - 1 (n below 2**31): a seeded shift and a multiplication by a prime that does not divide n."""
    fit = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: p % n != 0)
    return F.when(n > 1, (F.pmod(i + F.pmod(seed, n), n) * (F.element_at(fit, 1) % n)) % n).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, share: float = 1.0, block_words: int = 2048, levels: int = 5, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, segments) of the mix of ``docs``.

    ``rows`` has a row per document: all its columns, ``size`` (words), ``source_size``, ``target`` and its
    key (``nth``, ``slice``, ``rn``).  ``segments`` has what the mix takes: that key, ``pass``, ``block``,
    ``shard``, ``place`` (order within the shard), ``from_word`` and ``to_word``.  A source's segments add up
    to its target, rounded down to whole words; no word is taken more than ``max_repeats`` times; ties in
    the order key are broken by id and text, so that runs agree.  A null text has no words, a null source is a source of its
    own, rows that repeat are taken as documents of their own, and an empty table gives empty results.
    """
    keyed = docs.withColumn("size", word_count(F.col("text")))
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("size"))
    goal = saved(targets(sizes, weights, max_repeats, share), "targets")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    slim = keyed.select("doc_id", "source", "size", order.alias("key"), F.xxhash64("text").alias("th"))
    slim = slim.withColumn("slice", F.substring("key", 1, SLICE_DIGITS)).join(goal, slim.source.eqNullSafe(goal.source)).drop(goal.source)
    within = Window.partitionBy("nth", "slice").orderBy("key", "doc_id", "th")
    slim = slim.withColumn("rn", F.row_number().over(within)).withColumn("end", F.sum("size").over(within))
    # running sums of a source: of its slices first, then within a slice
    sums = keyed.groupBy("source", F.substring(order, 1, SLICE_DIGITS).alias("slice")).agg(F.sum("size").alias("sum"))
    ends = F.sum("sum").over(Window.partitionBy("source").orderBy("slice"))
    starts = sums.select(F.col("source").alias("source2"), F.col("slice").alias("slice2"), (ends - F.col("sum")).alias("start"))
    slim = slim.join(starts, slim.source.eqNullSafe(starts.source2) & (slim.slice == starts.slice2)).drop("source2", "slice2")
    slim = slim.withColumn("o", F.col("start") + F.col("end") - F.col("size"))
    rows = saved(slim.select("doc_id", "source", "th", "nth", "slice", "rn", "size", "source_size", "target", "o"), "stream")

    passes = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass")
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("source_size"), F.floor("target") - F.col("pass") * F.col("source_size")))
    per_pass = goal.select("nth", "source_size", "target", passes).select("nth", "pass", words.alias("words")).withColumn("blocks", F.ceil(F.col("words") / block_words))
    first = F.sum("blocks").over(Window.partitionBy("nth").orderBy("pass")) - F.col("blocks")
    per_pass = saved(per_pass.select("*", first.alias("first"), F.sum("blocks").over(Window.partitionBy("nth")).alias("quota")), "passes")
    quotas = per_pass.where("pass = 0").select("nth", F.col("quota").alias("blocks"))
    leaves = shard_quotas(quotas, levels, seed).where("blocks > 0")
    drawn = leaves.select("nth", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)).alias("at"))

    parts = rows.where("size > 0").join(per_pass.where("words > 0"), "nth").where("o < words")
    stop = F.least(F.col("o") + F.col("size"), F.col("words"))
    parts = parts.withColumn("stop", stop).withColumn("block", F.explode(F.sequence(F.floor(F.col("o") / block_words), F.floor((F.col("stop") - 1) / block_words))))
    begin, end = F.greatest(F.col("o"), F.col("block") * block_words), F.least(F.col("stop"), (F.col("block") + 1) * block_words)
    parts = parts.select("nth", "slice", "rn", "pass", "block", _permuted(F.col("first") + F.col("block"), F.col("quota"), F.xxhash64(F.lit(seed), "nth")).alias("at"), (begin - F.col("o")).alias("from_word"), (end - F.col("o")).alias("to_word"))
    segments = parts.join(drawn, ["nth", "at"]).withColumn("place", F.xxhash64(F.lit(seed), "nth", "at"))
    return rows, segments.drop("at")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row per document and pass with what the mix takes of it, all columns of ``docs``.

    A document that is taken whole keeps its text as it is; of one that a target cuts, the words taken are
    joined by spaces.  Rows of one shard follow each other (``shard``, ``place``).
    """
    rows, segments = mix(docs, **how)
    taken = segments.groupBy("nth", "slice", "rn", "pass").agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"), F.min(F.struct("block", "shard", "place")).alias("b"))
    taken = taken.join(rows, ["nth", "slice", "rn"]).select(F.col("doc_id").alias("__id"), "th", "rn", "pass", "size", "from_word", "to_word", "b.shard", "b.place")
    # rows that repeat an id and a text: each is matched with one row of docs.  The copy's number is no key of
    # the join, so that the texts are dealt out once for both the window and the join
    taken = taken.withColumn("copy", F.row_number().over(Window.partitionBy("__id", "th", "pass").orderBy("rn")))
    taken = taken.select(*[F.col(c).alias(f"__{c.strip('_')}") for c in taken.columns]).withColumn("__id", F.coalesce("__id", F.lit(-(2**63))))
    own = docs.withColumn("__id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("__th", F.xxhash64("text"))
    own = own.withColumn("__own", F.row_number().over(Window.partitionBy("__id", "__th").orderBy(F.lit(0))))
    full = own.join(taken, (own["__id"] == taken["__id"]) & (own["__th"] == taken["__th"]) & (F.col("__own") - F.col("__copy") == 0))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    cut = F.array_join(F.slice(words, (F.col("__from_word") + 1).cast("int"), (F.col("__to_word") - F.col("__from_word")).cast("int")), " ")
    text = F.when((F.col("__from_word") == 0) & (F.col("__to_word") == F.col("__size")), F.col("text")).otherwise(cut)
    added = {"pass": "__pass", "shard": "__shard", "place": "__place"}
    return full.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in added], *[F.col(v).alias(k) for k, v in added.items()])
