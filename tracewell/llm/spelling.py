"""Spelling variants of a corpus' words: pairs one edit apart, each word's likely form, and its root.

The join is asymmetric.  Of two near words the longer one (either, if equally long) contributes chunks, its
two halves; the other one its positional grams.  One inserted, deleted or replaced code point leaves a half
whole, and the other word holds it at the same place or shifted by the difference in length, at most one.
Halves alone are too common to meet on, so the half with the edit is cut further, into pieces of two code
points (a sixteenth of very long words): a pair has all of the word but one piece in common, at a known
place, and the key of the join is a hash of just that, with the length and the piece.  So the words that
meet under a key differ within one piece, and their number is bounded by the alphabet and not by the
corpus.  Each pair that meets is verified by its edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run, code points and occurrences a word needs, and how many times as frequent a form is.
LETTERS, MIN_CHARS, MIN_COUNT, TIMES = r"[A-Za-zÀ-ÿ]", 6, 5, 5
#: A run loses a code point where this divides the checksum of its document and text.
NOISE = 199


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): lower-cased runs of letters, counted over all documents."""
    # a run of fewer letters can't become a word; a greedy match of at least that many is a maximal run
    run = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    lower = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("id", lower.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _pieces(m: Column) -> Column:
    """(from, to) of the pieces of a word of ``m`` code points; none crosses the middle."""
    step = F.greatest(F.lit(2), F.ceil(m / 16).cast("int"))
    half = (m / 2).cast("int")
    cut = lambda low, high: F.transform(F.sequence(low, high - 1, step), lambda s: F.struct(s.alias("s"), F.least(s + step, high).alias("e")))
    return F.concat(cut(F.lit(0), half), cut(half, m))


def _keys(words: DataFrame, longer: int) -> DataFrame:
    """(key, word, n): ``word`` without each piece, as seen from a word ``longer`` by so many code points."""
    m = F.char_length("word") + longer
    pieces = words.select("word", "n", m.alias("m"), F.explode(_pieces(m)).alias("p"))
    rest = F.col("m") - F.col("p.e")
    before, after = F.substring("word", F.lit(1), F.col("p.s")), F.substring("word", F.char_length("word") - rest + 1, rest)
    return pieces.select(F.xxhash64("m", "p.s", before, after).alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each unordered pair of distinct ``words`` (word, n) one edit apart, once."""
    chunks, grams = _keys(words, 0), _keys(words, 1)
    held = chunks.select("key", "word", "n", F.lit(False).alias("shorter")).union(grams.select("key", "word", "n", F.lit(True).alias("shorter")))
    held = held.select(F.col("key").alias("k"), F.col("word").alias("b"), F.col("n").alias("n_b"), "shorter")
    met = chunks.select("key", F.col("word").alias("a"), F.col("n").alias("n_a")).join(held, (F.col("key") == F.col("k")) & (F.col("shorter") | (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form), by doubling the steps; a form is more frequent than its word, so
    there are no circles and few rounds."""
    now = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words`` (word, n).

    ``form`` is the most frequent near word (ties: the smallest in code-point order) if it is at least
    ``times`` as frequent, else null; ``root`` follows forms to the last one, or is the word itself.
    """
    pairs = saved(near_pairs(words), "near")
    ways = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    ways = ways.union(pairs.select("b", "n_b", "a", "n_a"))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"), F.first("n").alias("n_"))
    enough = -F.col("best.less") >= times * F.col("n_")
    best = saved(best.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "best")
    roots = _roots(best.where("form IS NOT NULL"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int = NOISE, times: int = TIMES) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text; other columns are left out).

    Null and empty texts have no words; a null id counts as an empty one in the checksum; rows that repeat
    count each time; an empty table gives no rows.
    """
    words = saved(word_counts(docs.select("doc_id", "text"), min_chars, min_count, noise), "words")
    return variants(words, times)
