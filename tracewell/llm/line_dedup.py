"""Lines that repeat across documents, found without Python and answered as keep bitmaps.

Every document is split at ``\\n``.  A line's key is the line without the six ASCII white space characters
at both ends and with A-Z in lower case; only keys of at least ``min_chars`` code points count.  Hashes of
the keys are partitioned by range and sorted by document, largest first, and position, so that the first
row of a hash is the occurrence that stays.  A hash is dealt over ``SLICES`` slices by document: each slice
streams its first occurrence, and the few firsts of a hash are then compared with each other, so a line
that a third of all documents share is no single task.

The answer holds no text: per document a run-length encoded keep bitmap, ``runs`` = lines kept, lines
dropped, lines kept, ... in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import saved

#: Slices of one hash.
SLICES = 32
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key() -> list[Column]:
    """What tells rows apart: the id (a null one is below all others) and the text."""
    return [F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), F.xxhash64("text").alias("__text")]


def _runs(n: Column, dropped: Column) -> Column:
    """Run lengths, kept lines first, of a bitmap of ``n`` lines with sorted ``dropped`` positions."""
    step = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("runs"))

    def add(acc, p):
        size, gap = F.size(acc["runs"]), p - acc["last"] - 1
        joined = F.concat(F.slice(acc["runs"], F.lit(1), size - 1), F.array(F.element_at(acc["runs"], -1) + 1))
        fresh = F.concat(acc["runs"], F.array(gap, F.lit(1)))
        return F.struct(p.alias("last"), F.when((gap == 0) & (size > 0), joined).otherwise(fresh).alias("runs"))

    done = F.aggregate(dropped, step, add)
    return F.concat(done["runs"], F.filter(F.array((n - done["last"] - 1).cast("int")), lambda x: x > 0))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``runs`` and ``dropped`` (their number) of every document that loses a line, keyed by ``__id`` and ``__text``.

    A line goes if its key is in at least ``min_docs`` documents, unless the document has the largest id of
    those.  Rows with one id are one document; a null id is one document below all others; a null text is
    one empty line; repeated lines within the largest document stay.  An empty table gives no row.
    """
    own = docs.select(*_row_key(), F.transform(lines_of(F.col("text")), line_key).alias("__keys"))
    at = own.select("__id", "__text", F.posexplode("__keys").alias("__pos", "__key")).where(F.char_length("__key") >= min_chars)
    at = at.select("__id", "__text", "__pos", F.xxhash64("__key").alias("h"), F.xxhash64(F.lit("second"), "__key").alias("g"), F.pmod(F.xxhash64("__id"), F.lit(SLICES)).cast("int").alias("slice"))
    # written once: the range bounds, the counts and the join all read the hashes, and none splits the texts again
    at = saved(at, "line-hashes")
    hashed = at.repartitionByRange("h", "slice")
    by_slice = Window.partitionBy("h", "slice", "g").orderBy(F.col("__id").desc(), "__pos")
    seen = hashed.select("h", "g", "slice", "__id", (F.coalesce(F.lag("__id").over(by_slice) != F.col("__id"), F.lit(True))).alias("new_doc"))
    firsts = seen.where("new_doc").groupBy("h", "slice", "g").agg(F.max("__id").alias("last_id"), F.count("*").alias("docs"))
    repeated = firsts.groupBy("h", "g").agg(F.max("last_id").alias("last_id"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    repeated = repeated.select("h", "g", "last_id", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    gone = at.join(repeated, ["h", "g", "slice"]).where(F.col("__id") != F.col("last_id"))
    per_doc = gone.groupBy("__id", "__text").agg(F.array_sort(F.collect_set("__pos")).alias("at"))
    return per_doc.select("__id", "__text", F.col("at").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the lines gone: all its columns, ``text`` replaced, plus ``n_lines`` (before), ``n_dropped`` and ``runs``.

    A document keeps its row even if all its lines go (its text is then empty).
    """
    gone = keep_bitmaps(docs, min_chars, min_docs).withColumnRenamed("dropped", "__dropped")
    full = docs.select("*", *_row_key()).join(gone, ["__id", "__text"], "left")
    n, dropped = F.size(lines_of(F.col("text"))), F.col("__dropped")
    full = full.withColumn("__n", n).withColumn("__runs", F.when(dropped.isNull(), F.array(n)).otherwise(_runs(n, dropped)))
    full = full.withColumn("__flags", F.when(dropped.isNotNull(), F.flatten(F.transform("__runs", lambda k, i: F.array_repeat(i % 2 == 0, k)))))
    kept = F.array_join(F.filter(lines_of(F.col("text")), lambda _, i: F.get("__flags", i)), "\n")
    kept = F.when(dropped.isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
    added = {"n_lines": F.col("__n").cast("long"), "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("long"), "runs": F.col("__runs")}
    return full.select(*[kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])
