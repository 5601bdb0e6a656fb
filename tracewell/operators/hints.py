"""The few files and symbols of a code corpus that fit a prompt: names and places, no bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators import search as S
from tracewell.operators.code import bare_name

# --- fixed values: weights of a named doc, of a symbol and of a file; the gate and the limits of an answer ---
NAMED, OF_SYMBOL, OF_FILE = 3.0, 1.0, 0.8
MIN_COVERAGE, MIN_MATCHED = 0.3, 2
FILE_NAME, SYMBOL_NAME, LEAST_NAME = 4, 5, 3
MOST_FILES, MOST_SYMBOLS, MOST_USED = 5, 3, 3


def split_identifier(name: Column) -> Column:
    """The words of an identifier or path in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_./-]+", " "))


def _docs(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A doc per file (symbol null) and per symbol: what it is called, with the path."""
    path = F.concat(F.lower("rel"), F.lit(" "), split_identifier(F.col("rel")))
    base = F.lower(F.regexp_replace(F.regexp_extract("rel", "([^/]*)$", 1), r"\.[^.]+$", ""))
    none = F.lit(None)
    by_file = files.select("project", "rel", none.cast("string").alias("symbol"), none.cast("int").alias("line"), base.alias("name"), path.alias("text"))
    name = bare_name(F.col("symbol"))
    text = F.concat(F.lower(name), F.lit(" "), split_identifier(name), F.lit(" "), path)
    by_symbol = symbols.select("project", "rel", "symbol", "line", F.lower(name).alias("name"), text.alias("text")).where(F.char_length("name") >= LEAST_NAME)
    return by_file.unionByName(by_symbol)


def code_ranked(prompts: DataFrame, files: DataFrame, symbols: DataFrame, stop: Sequence[str] = S.STOP) -> DataFrame:
    """(project, query_id, rel, symbol, line, score, matched, coverage, named) of all files and symbols that hold a term.

    BM25 over the names of a project; ``named``: the prompt holds a file's name as a word or a symbol's name.
    """
    docs = _docs(files, symbols).withColumn("doc", F.struct("project", "rel", "symbol"))
    of = docs.groupBy("project").agg(F.count("*").alias("total"), F.greatest(F.lit(1.0), F.avg(F.length("text"))).alias("mean"))
    q = prompts.select("project", "query_id", F.explode(S.query_terms(F.col("text"), stop)).alias("term"))
    counts = S.term_counts(docs, "doc", "text", q.select("term").distinct()).withColumn("project", F.col("doc.project"))
    df = counts.groupBy("project", "term").agg(F.count("*").alias("df"))
    found = F.coalesce("df", F.lit(0))
    q = q.join(of, "project").join(df, ["project", "term"], "left").withColumn("idf", F.log(1 + (F.col("total") - found + 0.5) / (found + 0.5)))
    whole = q.groupBy("project", "query_id").agg(F.sum("idf").alias("idf_sum"))
    norm = S.K1 * (1 - S.B + S.B * F.col("chars") / F.col("mean"))
    score = F.col("idf") * F.col("f") * (S.K1 + 1) / (F.col("f") + norm)
    hits = q.select("project", "query_id", "term", "idf", "mean").join(counts, ["project", "term"])
    hits = hits.groupBy("project", "query_id", "doc").agg(F.sum(score).alias("score"), F.count("*").alias("matched"), F.sum("idf").alias("covered"))
    hits = hits.join(whole, ["project", "query_id"]).join(prompts.select("project", "query_id", F.lower("text").alias("prompt")), ["project", "query_id"])
    hits = hits.join(docs.select("doc", "line", "name"), "doc")
    is_file, long = F.col("doc.symbol").isNull(), F.char_length("name")
    # a word boundary on both sides of the name
    word = F.concat(F.lit(r"\b\Q"), "name", F.lit(r"\E\b"))
    named = F.when(is_file, (long >= FILE_NAME) & F.regexp_like("prompt", word)).otherwise((long >= SYMBOL_NAME) & F.contains("prompt", "name"))
    weight = F.when(F.col("named"), NAMED).when(is_file, OF_FILE).otherwise(OF_SYMBOL)
    return hits.withColumn("named", named).select(
        "project", "query_id", "doc.rel", "doc.symbol", "line", (F.col("score") * weight).alias("score"), "matched", (F.col("covered") / F.col("idf_sum")).alias("coverage"), "named"
    )


def relevant_code(
    prompts: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, shown: DataFrame | None = None,
    most: int = MOST_FILES, strictness: float = 1.0, stop: Sequence[str] = S.STOP,
) -> DataFrame:
    """(project, query_id, nth, rel, bytes, score, symbols, uses): the best ``most`` files of each prompt.

    ``prompts``: project, query_id, text.  ``files``: project, rel, bytes.  ``symbols``, ``edges``: rows of
    ``extract_symbols`` and ``import_graph``.  ``shown`` (query_id, rel, symbol; null for the file itself) is
    left out.  A file or symbol counts if the prompt names it, or if it holds two terms and enough of the
    prompt's rarity, by ``strictness`` times more.  A file comes with its three best symbols (``symbols``:
    symbol and first line) and three files that it imports, in order of their paths.  Of equal scores
    (to nine places) the smaller path counts first, the file before its symbols, these by line.
    """
    hits = code_ranked(prompts, files, symbols, stop).where(F.col("named") | ((F.col("matched") >= MIN_MATCHED) & (F.col("coverage") >= MIN_COVERAGE * strictness)))
    if shown is not None:
        gone = shown.select("query_id", "rel", F.coalesce("symbol", F.lit("")).alias("__s")).distinct()
        hits = hits.withColumn("__s", F.coalesce("symbol", F.lit(""))).join(gone, ["query_id", "rel", "__s"], "left_anti").drop("__s")
    best = [F.round("score", 9).desc(), F.col("line").asc_nulls_first(), "symbol"]
    at = F.row_number().over(W.partitionBy("project", "query_id", "rel").orderBy(F.col("symbol").isNull(), *best))
    # a file's own doc is behind its symbols here, so that three of these stay, and its score counts all the same
    top = F.max("score").over(W.partitionBy("project", "query_id", "rel"))
    hits = hits.withColumns({"__at": at, "__top": top}).where((F.col("__at") <= MOST_SYMBOLS) | F.col("symbol").isNull())
    names = F.array_sort(F.collect_list(F.when((F.col("__at") <= MOST_SYMBOLS) & F.col("symbol").isNotNull(), F.struct("__at", "symbol", "line"))))
    per = hits.groupBy("project", "query_id", "rel").agg(F.max("__top").alias("score"), F.transform(names, lambda s: F.struct(s["symbol"].alias("symbol"), s["line"].alias("line"))).alias("symbols"))
    nth = F.row_number().over(W.partitionBy("project", "query_id").orderBy(F.round("score", 9).desc(), "rel"))
    per = per.withColumn("nth", nth).where(F.col("nth") <= most)
    first = F.row_number().over(W.partitionBy("project", "rel").orderBy("target"))
    used = edges.select("project", "rel", "target").distinct().withColumn("__n", first).where(F.col("__n") <= MOST_USED)
    used = used.groupBy("project", "rel").agg(F.array_sort(F.collect_list("target")).alias("uses"))
    per = per.join(files.select("project", "rel", "bytes"), ["project", "rel"]).join(used, ["project", "rel"], "left")
    return per.select("project", "query_id", "nth", "rel", "bytes", "score", "symbols", F.coalesce("uses", F.array().cast("array<string>")).alias("uses"))
