"""Code corpora: declared symbols, imports between files, and the files worth showing under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.text import token_estimate
from tracewell.operators.budget import budget_skip

# --- fixed values: languages by file extension ---
LANGUAGES = {
    "py": "python", "pyi": "python",
    "ts": "ts", "tsx": "ts", "mts": "ts", "cts": "ts",
    "js": "js", "jsx": "js", "mjs": "js", "cjs": "js",
    "java": "java", "kt": "kotlin", "scala": "scala", "cs": "cs",
    "go": "go", "rs": "rust", "swift": "swift", "dart": "dart",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "php": "php",
}
# --- fixed values: top-level declarations (language, or null for the other known ones; pattern; group of the kind, 0 for none; group of the name) ---
SCRIPT_EXPORT = r"^export\s+(?:default\s+)?(?:declare\s+)?(?:async\s+)?(function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"
DECLARATIONS = [
    ("python", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)", "()", 0, 1),
    ("python", r"^(class)\s+([A-Za-z_]\w*)", "", 1, 2),
    ("go", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "()", 0, 1),
    ("go", r"^type\s+([A-Za-z_]\w*)\s+(struct|interface)", "", 2, 1),
    ("rust", r"^\s*pub(?:\([^)]*\))?\s+(?:async\s+)?fn\s+([A-Za-z_]\w*)", "()", 0, 1),
    ("rust", r"^\s*pub(?:\([^)]*\))?\s+(struct|enum|trait)\s+([A-Za-z_]\w*)", "", 1, 2),
    ("script", SCRIPT_EXPORT, "", 1, 2),
    ("script", r"^(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "()", 0, 1),
    ("script", r"^(class)\s+([A-Za-z_$][\w$]*)", "", 1, 2),
    (None, r"^\s*(?:public|export)?\s*(?:abstract\s+|final\s+|sealed\s+)*(class|interface|struct|enum|record)\s+([A-Za-z_]\w*)", "", 1, 2),
]
#: A line that fits no rule of any language declares nothing.
ANY_DECLARATION = "|".join(f"(?:{pattern})" for _, pattern, *_ in DECLARATIONS)
# --- fixed values: import statements ---
PYTHON_IMPORT = r"(?m)^\s*from\s+([.\w]+)\s+import|^\s*import\s+([.\w]+)"
GO_IMPORT, GO_BLOCK = r'(?m)^\s*import\s+(?:\w+\s+)?"([^"]+)"', r"import\s*\(([\s\S]*?)\)"
RUST_IMPORT = r"(?m)^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)"
SCRIPT_IMPORT = r"""(?:import|export)\s[^'"`;]*?from\s*['"]([^'"]+)['"]|import\s*['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)|import\(\s*['"]([^'"]+)['"]\s*\)"""
# --- fixed values: weights of the rank ---
ENTRY_FILE = r"(?i)(^|/)(readme|index|main|app|server|cli)\."
IMPORTED, DECLARED, NEW, ENTRY = 3.0, 0.5, 2.0, 3.0
MAP_TOKENS, MAP_SYMBOLS = 1500, 12

SEARCHED = r"^(?:(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var|def|fn|func|struct|trait)\s+)?([A-Za-z_$][\w$]{3,})$"
KIND_WORD = r"^(class|interface|type|enum|struct|trait|record)\s+"
PLACES = 3


def language(rel: Column) -> Column:
    """Language of a file by its extension, or null."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1)))


def _declared(line: Column, lang: Column) -> Column:
    """The symbol that a line declares, or null: the first rule of its language that fits."""
    script = lang.isin("ts", "js")
    other = lang.isNotNull() & ~script & ~lang.isin("python", "go", "rust")
    found = []
    for name, pattern, after, kind, group in DECLARATIONS:
        of = script if name == "script" else other if name is None else lang == name
        word = F.regexp_extract(line, pattern, group)
        if pattern == SCRIPT_EXPORT:
            k = F.replace(F.regexp_extract(line, pattern, kind), F.lit("*"), F.lit(""))
            word = F.when(k == "function", F.concat(word, F.lit("()"))).when(k.isin("const", "let", "var"), word).otherwise(F.concat_ws(" ", k, word))
        elif kind:
            word = F.concat_ws(" ", F.regexp_extract(line, pattern, kind), word)
        else:
            word = F.concat(word, F.lit(after))
        found.append(F.when(of & line.rlike(pattern), word))
    return F.coalesce(*found)


def extract_symbols(files: DataFrame) -> DataFrame:
    """(project, rel, symbol, line): top-level declarations of ``files`` (project, rel, text), the first line of each."""
    lines = files.select("project", "rel", language(F.col("rel")).alias("lang"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where("lang IS NOT NULL")
    lines = lines.where(F.col("line").rlike(ANY_DECLARATION))
    found = lines.select("project", "rel", _declared(F.col("line"), F.col("lang")).alias("symbol"), (F.col("at") + 1).alias("line")).where("symbol IS NOT NULL")
    return found.groupBy("project", "rel", "symbol").agg(F.min("line").alias("line"))


def extract_imports(files: DataFrame) -> DataFrame:
    """(project, rel, spec, nth): distinct import specifiers of ``files`` (project, rel, text) in source order."""
    text, lang = F.col("text"), language(F.col("rel"))
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    either = F.zip_with(every(PYTHON_IMPORT, 1), every(PYTHON_IMPORT, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    blocks = F.flatten(F.transform(every(GO_BLOCK, 1), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1))))
    # each alternative ends with the only quoted part
    script = F.transform(every(SCRIPT_IMPORT, 0), lambda m: F.regexp_extract(m, r"""['"]([^'"]+)['"]\s*\)?$""", 1))
    specs = F.when(lang == "python", either).when(lang == "go", F.concat(every(GO_IMPORT, 1), blocks)).when(lang == "rust", every(RUST_IMPORT, 1)).otherwise(script)
    return files.select("project", "rel", F.posexplode(F.array_distinct(specs)).alias("nth", "spec")).where("spec <> ''").select("project", "rel", "spec", "nth")


def normalized(path: Column) -> Column:
    """A path without ``.`` and empty parts; ``..`` takes away the part before it, and stays where there is none."""

    def add(parts, p):
        up = (p == "..") & (F.size(parts) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), parts), -1) != "..")
        return F.when(up, F.slice(parts, F.lit(1), F.size(parts) - 1)).when((p == ".") | (p == ""), parts).otherwise(F.concat(parts, F.array(p)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add), "/")
    return F.when(path.endswith("/") & (joined != ""), F.concat(joined, F.lit("/"))).otherwise(joined)


def import_graph(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, rel, spec, target): relative imports that name another file of the project.

    A specifier names a file by its path, its path without extension, or the folder of an index file; of
    several files the first of these ways counts, then the larger path.  Read by target it says which files import one.
    """
    keys = F.array(
        F.struct(F.lit(0).alias("way"), F.col("rel").alias("key")),
        F.struct(F.lit(1).alias("way"), F.regexp_replace("rel", r"\.[^./]+$", "").alias("key")),
        F.struct(F.lit(2).alias("way"), F.regexp_replace("rel", r"/index\.[^./]+$", "").alias("key")),
    )
    names = files.select("project", F.col("rel").alias("target"), F.inline(keys))
    best = names.groupBy("project", "key").agg(F.max_by("target", F.struct(-F.col("way"), "target")).alias("target"))
    folder = F.regexp_replace("rel", "[^/]*$", "")
    named = F.regexp_replace(normalized(F.concat(folder, "spec")), r"\.(js|mjs|cjs)$", "")
    wanted = imports.where(F.col("spec").startswith(".")).withColumn("key", named)
    return wanted.join(best, ["project", "key"]).where("target <> rel").select("project", "rel", "spec", "target")


def repo_rank(files: DataFrame, symbols: DataFrame, edges: DataFrame, boost: DataFrame | None = None) -> DataFrame:
    """``files`` (project, rel, bytes, mtime) with imported_by, n_symbols, score and rank (ties by path).

    ``boost`` (project, rel, boost) adds to the score, as for files that sessions touch often.
    """
    used = edges.groupBy("project", F.col("target").alias("rel")).agg(F.count("*").alias("imported_by"))
    declared = symbols.groupBy("project", "rel").agg(F.count("*").alias("n_symbols"))
    newest = files.groupBy("project").agg(F.greatest(F.max("mtime"), F.lit(1)).alias("newest"), F.count("*").alias("n_files"))
    df = files.select("project", "rel", "bytes", "mtime").join(used, ["project", "rel"], "left").join(declared, ["project", "rel"], "left").join(newest, "project")
    if boost is not None:
        df = df.join(boost.select("project", "rel", "boost"), ["project", "rel"], "left")
    df = df.withColumns({"imported_by": F.coalesce("imported_by", F.lit(0)), "n_symbols": F.coalesce("n_symbols", F.lit(0))})
    extra = F.lit(0.0) if boost is None else F.coalesce("boost", F.lit(0.0))
    score = F.col("imported_by") * IMPORTED + F.col("n_symbols") * DECLARED + F.col("mtime") / F.col("newest") * NEW + F.when(F.col("rel").rlike(ENTRY_FILE), ENTRY).otherwise(0.0) + extra
    order = W.partitionBy("project").orderBy(F.col("score").desc(), "rel")
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(order)).drop("newest")


def repo_map(ranked: DataFrame, symbols: DataFrame, tokens: int = MAP_TOKENS, most: int = MAP_SYMBOLS) -> DataFrame:
    """(project, rel, folder, rank, line, tokens): what a map of the repository shows, the best files that fit.

    Files are taken by rank; one that does not fit is skipped, and later ones may.  A heading with the
    project's number of files counts too, as the row of rank 0 without a path.
    """
    first = F.row_number().over(W.partitionBy("project", "rel").orderBy("line", "symbol"))
    names = symbols.withColumn("nth", first).where(F.col("nth") <= most).groupBy("project", "rel").agg(F.array_sort(F.collect_list(F.struct("nth", "symbol"))).alias("s"))
    df = ranked.join(names, ["project", "rel"], "left")
    size = F.when(F.col("bytes") >= 1024, F.concat(F.floor(F.col("bytes") / 1024 + 0.5).cast("string"), F.lit("k"))).otherwise(F.concat(F.col("bytes").cast("string"), F.lit("b")))
    used = F.when(F.col("imported_by") > 0, F.concat(F.lit(" ←"), F.col("imported_by").cast("string"))).otherwise("")
    more = F.when(F.col("n_symbols") > most, F.concat(F.lit(" +"), (F.col("n_symbols") - most).cast("string"))).otherwise("")
    shown = F.when(F.col("n_symbols") > 0, F.concat(F.lit(": "), F.array_join(F.col("s.symbol"), ", "), more)).otherwise("")
    line = F.concat(F.lit("  "), F.regexp_extract("rel", "([^/]*)$", 1), F.lit(" ("), size, used, F.lit(")"), shown, F.lit("\n"))
    folder = F.regexp_extract("rel", "^(.*/)?[^/]*$", 1)
    rows = df.select("project", "rel", F.when(folder == "", "./").otherwise(folder).alias("folder"), F.col("rank").cast("bigint").alias("rank"), line.alias("line"))
    heading = F.concat(F.lit("# repo map: "), "project", F.lit(" ("), F.max("n_files").cast("string"), F.lit(" files)\n"))
    none = F.lit(None).cast("string")
    heads = ranked.groupBy("project").agg(heading.alias("line")).select("project", none.alias("rel"), none.alias("folder"), F.lit(0).cast("bigint").alias("rank"), "line")
    costed = rows.unionByName(heads).withColumn("tokens", token_estimate(F.col("line")))
    return budget_skip(costed, ["project"], "rank", "tokens", tokens)


def grep_symbol(pattern: Column) -> Column:
    """The one identifier a search pattern is after, with or without the word that declares it; else null."""
    p = F.regexp_replace(F.trim(pattern), r"\\?\(.*$", "")
    for mark in (r"^\\b|\\b$", r"^\^|\$$"):
        p = F.regexp_replace(p, mark, "")
    return F.nullif(F.regexp_extract(p, SEARCHED, 1), F.lit(""))


def bare_name(symbol: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(symbol, r"\(\)$", ""), KIND_WORD, "")


def symbol_lookup(searches: DataFrame, symbols: DataFrame, most: int = PLACES) -> DataFrame:
    """(project, pattern, name, nth, rel, line): where the identifier that a search is after is declared.

    ``searches``: project, pattern; those that are after no single identifier have no rows, repeated ones
    have theirs once.  ``symbols``: rows of ``extract_symbols``.  The first ``most`` files in order of their
    paths; they are chosen once per name, so a name that every file declares is no long list.
    """
    asked = searches.select("project", "pattern", grep_symbol(F.col("pattern")).alias("name")).where("name IS NOT NULL").distinct()
    places = symbols.groupBy("project", bare_name(F.col("symbol")).alias("name"), "rel").agg(F.min("line").alias("line"))
    nth = F.row_number().over(W.partitionBy("project", "name").orderBy("rel"))
    return asked.join(places.withColumn("nth", nth).where(F.col("nth") <= most), ["project", "name"]).select("project", "pattern", "name", "nth", "rel", "line")
