"""Code files made of ``part`` (a file each, its project the brand) whose imports are the suppliers of ``lineitem``."""

from pyspark.sql import functions as F

from tracewell.operators import budget
from tracewell.operators import code as C
from tracewell.operators import hints
from tracewell.plans.registry import query, table
from tracewell.plans.search import terms_sql
from tracewell.session import written

# every tenth file is an index file, every third of the others Python; the rest TypeScript, in seven folders
FILES = """pw AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w, p_size, p_retailprice, 'p' || (p_partkey % 3) AS project FROM part),
files AS (SELECT *, 'd' || k % 7 || '/f' || k || CASE WHEN k % 10 = 0 THEN '/index.ts' WHEN k % 3 = 1 THEN '.py' ELSE '.ts' END AS rel, k % 10 <> 0 AND k % 3 = 1 AS py FROM pw)"""
DECLARED = """syms AS (SELECT project, rel, symbol, min(line) AS line FROM (
  SELECT project, rel, unnest(CASE WHEN py THEN [w[1] || '()', 'class ' || w[-1], 'a' || k || '()'] ELSE [w[1] || '()', 'class ' || w[-1], w[1], 'a' || k || '()', 'type T' || k] END) AS symbol,
    unnest(CASE WHEN py THEN [1, 2, 5] ELSE [1, 2, 4, 5, 6] END) AS line FROM files) GROUP BY ALL)"""
# a specifier names the part with the supplier's number; only files of the same project resolve
EDGES = """li AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS t FROM lineitem),
edges AS (SELECT a.project, a.rel, CASE WHEN t % 5 = 0 THEN '../d' || t % 7 || '/../d' || t % 7 || '/f' || t WHEN t % 7 = a.k % 7 AND a.k % 10 <> 0 THEN './f' || t ELSE CASE WHEN a.k % 10 = 0 THEN '../' ELSE '' END || '../d' || t % 7 || '/f' || t || CASE WHEN t % 4 = 1 THEN '.js' ELSE '' END END AS spec, b.rel AS target
  FROM li JOIN files a USING (k) JOIN files b ON b.k = t AND b.project = a.project WHERE NOT a.py AND a.rel <> b.rel AND NOT (t % 5 = 0 AND a.k % 10 = 0))"""


def files(spark, d):
    """Written once: their texts are put together from all of ``lineitem``, and symbols, imports and ranks each read them."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    python = (k % 10 != 0) & (k % 3 == 1)
    rel = F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/f"), k.cast("string"), F.when(k % 10 == 0, "/index.ts").when(python, ".py").otherwise(".ts"))
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(-1))
    t = F.col("l_suppkey")
    up = F.when(F.col("l_partkey") % 10 == 0, "../").otherwise("")
    place = lambda *after: F.concat(F.lit("../d"), (t % 7).cast("string"), *after, F.lit("/f"), t.cast("string"))
    spec = F.when(t % 5 == 0, place(F.lit("/../d"), (t % 7).cast("string"))).when((t % 7 == F.col("l_partkey") % 7) & (F.col("l_partkey") % 10 != 0), F.concat(F.lit("./f"), t.cast("string")))
    spec = spec.otherwise(F.concat(up, place(), F.when(t % 4 == 1, ".js").otherwise("")))
    imports = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().select(F.col("l_partkey").alias("p_partkey"), t.alias("t"), spec.alias("spec"))
    forms = F.when(F.col("t") % 3 == 0, F.concat(F.lit("import '"), "spec", F.lit("';"))).when(F.col("t") % 3 == 1, F.concat(F.lit('import { a,\n  b } from "'), "spec", F.lit('";')))
    forms = forms.otherwise(F.concat(F.lit("const x = require( '"), "spec", F.lit("' );")))
    imports = imports.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("t", forms.alias("s")))).alias("i"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    key = k.cast("string")
    py = say("def ", first, "(self):\nclass ", last, ":\n  def inner():\nclassy = 1\nasync def a", key, "():\nfrom .f5 import x\n")
    ts = say("export async function ", first, "() {\nclass ", last, " {\n  class Inner {}\nexport const ", first, " = 2\nfunction a", key, "() {}\nexport declare type T", key, " = 1\nexport default 3\n")
    text = F.when(python, py).otherwise(say(ts, F.coalesce(F.array_join(F.col("i.s"), "\n"), F.lit(""))))
    df = p.join(imports, "p_partkey", "left").select(F.concat(F.lit("p"), (k % 3).cast("string")).alias("project"), rel.alias("rel"), text.alias("text"), (F.col("p_size") * 100).cast("bigint").alias("bytes"), F.floor("p_retailprice").alias("mtime"))
    return written(df, "files")


def corpus(spark, d):
    """(files, symbols, edges) for what reads symbols more than once."""
    df = files(spark, d)
    return df, written(C.extract_symbols(df), "symbols"), C.import_graph(df, C.extract_imports(df))


@query("symbols", f"WITH {FILES}, {DECLARED} SELECT * FROM syms")
def symbols(spark, d):
    return C.extract_symbols(files(spark, d))


def edges(spark, d):
    df = files(spark, d)
    return C.import_graph(df, C.extract_imports(df))


@query("import_graph", f"WITH {FILES}, {EDGES} SELECT * FROM edges")
def import_graph(spark, d):
    return edges(spark, d)


@query(
    "reverse_imports",
    f"WITH {FILES}, {EDGES} SELECT project, target, count(*) AS n, count(DISTINCT rel) AS n_files, min(rel) AS first_file FROM edges GROUP BY ALL",
)
def reverse_imports(spark, d):
    return edges(spark, d).groupBy("project", "target").agg(F.count("*").alias("n"), F.count_distinct("rel").alias("n_files"), F.min("rel").alias("first_file"))


SCORED = f"""{FILES}, {DECLARED}, {EDGES},
u AS (SELECT project, target AS rel, count(*) AS imported_by FROM edges GROUP BY ALL), s AS (SELECT project, rel, count(*) AS n_symbols FROM syms GROUP BY ALL),
scored AS (SELECT project, rel, p_size * 100 AS bytes, coalesce(imported_by, 0) AS imported_by, coalesce(n_symbols, 0) AS n_symbols, count(*) OVER (PARTITION BY project) AS n_files,
  coalesce(imported_by, 0) * 3.0::DOUBLE + coalesce(n_symbols, 0) * 0.5::DOUBLE + floor(p_retailprice) / max(floor(p_retailprice)) OVER (PARTITION BY project) * 2.0::DOUBLE + CASE WHEN k % 10 = 0 THEN 3.0::DOUBLE ELSE 0 END AS score
  FROM files LEFT JOIN u USING (project, rel) LEFT JOIN s USING (project, rel)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY round(score, 9) DESC, rel) AS rank FROM scored)"""


def ranked(spark, d):
    df = files(spark, d)
    return C.repo_rank(df, C.extract_symbols(df), C.import_graph(df, C.extract_imports(df)))


@query("repo_rank", f"WITH {SCORED} SELECT project, rel, imported_by, n_symbols, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def repo_rank(spark, d):
    return ranked(spark, d).select("project", "rel", "imported_by", "n_symbols", F.round("score", 6).alias("score"), "rank")


GREEDY = """g(grp, rank, used, taken) AS (
  SELECT DISTINCT grp, 0::BIGINT, 0::BIGINT, false FROM c
  UNION ALL SELECT c.grp, c.rank, CASE WHEN used + cost <= {budget} THEN used + cost ELSE used END, used + cost <= {budget} FROM g JOIN c ON c.grp = g.grp AND c.rank = g.rank + 1)"""


@query(
    "budget_skip",
    f"""WITH RECURSIVE c AS (SELECT p_brand AS grp, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, p_partkey, CAST(p_size AS BIGINT) AS cost FROM part), {GREEDY.format(budget=300)}
SELECT grp, rank, p_partkey, cost FROM g JOIN c USING (grp, rank) WHERE taken""",
)
def budget_skip(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    df = table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.row_number().over(order).cast("bigint").alias("rank"), "p_partkey", F.col("p_size").cast("bigint").alias("cost"))
    return budget.budget_skip(df, ["grp"], "rank", "cost", 300)


@query(
    "repo_map",
    f"""WITH RECURSIVE {SCORED},
l AS (SELECT project, rel, rank, '  ' || regexp_extract(rel, '([^/]*)$', 1) || ' (' || CASE WHEN bytes >= 1024 THEN floor(bytes / 1024.0 + 0.5)::INT || 'k' ELSE bytes || 'b' END || CASE WHEN imported_by > 0 THEN ' ←' || imported_by ELSE '' END || ')'
    || coalesce(': ' || (SELECT string_agg(symbol, ', ' ORDER BY line, symbol) FROM (SELECT * FROM syms WHERE syms.project = ranked.project AND syms.rel = ranked.rel ORDER BY line, symbol LIMIT 3)), '') || CASE WHEN n_symbols > 3 THEN ' +' || n_symbols - 3 ELSE '' END || chr(10) AS line, regexp_extract(rel, '^(.*/)?[^/]*$', 1) AS folder FROM ranked
  UNION ALL SELECT project, NULL, 0, '# repo map: ' || project || ' (' || count(*) || ' files)' || chr(10), NULL FROM ranked GROUP BY project),
c AS (SELECT project AS grp, rank + 1 AS rank, rel, folder, line, CAST(ceil(length(line) / CASE WHEN length(regexp_replace(line, '[^{{}}()\\[\\];=<>+\\-*/\\\\|&^%$#@!~`"'',.:]', '', 'g')) / length(line)::DOUBLE > 0.08 THEN 3.2::DOUBLE ELSE 4.0::DOUBLE END) AS BIGINT) AS cost FROM l), {GREEDY.format(budget=900)}
SELECT grp AS project, rel, folder, rank - 1 AS rank, line, cost AS tokens FROM g JOIN c USING (grp, rank) WHERE taken""",
)
def repo_map(spark, d):
    df, symbols, imports = corpus(spark, d)
    return C.repo_map(C.repo_rank(df, symbols, imports), symbols, 900, 3)


# each part's number gives a kind of search; every fourth is after no single name
@query(
    "symbol_lookup",
    f"""WITH {FILES}, {DECLARED}, pat AS (SELECT DISTINCT project, CASE k % 4 WHEN 0 THEN '\\b' || w[1] || '\\b' WHEN 1 THEN 'class ' || w[-1] WHEN 2 THEN 'function a' || k || '(' ELSE 'x.*' || w[1] END AS pattern,
  CASE k % 4 WHEN 0 THEN w[1] WHEN 1 THEN w[-1] WHEN 2 THEN 'a' || k END AS name FROM files),
sy AS (SELECT project, rel, regexp_replace(regexp_replace(symbol, '\\(\\)$', ''), '^(class|type) ', '') AS name, min(line) AS line FROM syms GROUP BY ALL),
pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY project, name ORDER BY rel) AS INTEGER) AS nth FROM sy QUALIFY nth <= 3)
SELECT project, pattern, name, nth, rel, line FROM pat JOIN pl USING (project, name) WHERE length(name) >= 4""",
)
def symbol_lookup(spark, d):
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(-1))
    pattern = F.when(k % 4 == 0, F.concat(F.lit("\\b"), first, F.lit("\\b"))).when(k % 4 == 1, F.concat(F.lit("class "), last)).when(k % 4 == 2, F.concat(F.lit("function a"), key, F.lit("(")))
    searches = table(spark, d, "part").select(F.concat(F.lit("p"), (k % 3).cast("string")).alias("project"), pattern.otherwise(F.concat(F.lit("x.*"), first)).alias("pattern"))
    return C.symbol_lookup(searches, C.extract_symbols(files(spark, d)))


def ident_sql(x):
    return f"lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_./-]+', ' ', 'g'))"


# a prompt for each brand's parts of a project: its last part's first word and file, an index, and the next part's function
@query(
    "relevant_code",
    f"""WITH {FILES}, {DECLARED}, {EDGES},
ask AS (SELECT project, p_brand AS query_id, 'Fix ' || arg_max(w[1], k) || ' of f' || max(k) || ' and the index of a' || max(k) + 1 AS text FROM files JOIN (SELECT p_partkey AS k, p_brand FROM part) USING (k) GROUP BY ALL),
{terms_sql("qt", "ask", "project, query_id")},
nm AS (SELECT project, rel, symbol, line, lower(regexp_replace(regexp_replace(symbol, '\\(\\)$', ''), '^(class|type) ', '')) AS name, regexp_replace(regexp_replace(symbol, '\\(\\)$', ''), '^(class|type) ', '') AS bare FROM syms),
ds AS (SELECT project, rel, NULL AS symbol, NULL::INT AS line, regexp_replace(regexp_extract(rel, '[^/]*$'), '\\.[^.]+$', '') AS name, lower(rel) || ' ' || {ident_sql("rel")} AS t FROM files
  UNION ALL SELECT project, rel, symbol, line, name, name || ' ' || {ident_sql("bare")} || ' ' || lower(rel) || ' ' || {ident_sql("rel")} FROM nm WHERE length(name) >= 3),
st AS (SELECT project, count(*) AS total, avg(length(t)) AS mean FROM ds GROUP BY 1),
te AS (SELECT project, query_id, unnest(terms) AS term FROM qt),
tf AS (SELECT * FROM (SELECT ds.*, term, least(20, CASE WHEN length(term) > 3 THEN (length(t) - length(replace(t, term, ''))) // length(term) ELSE len(regexp_extract_all(t, '(^|[^a-z0-9])' || term)) END) AS f
  FROM ds JOIN (SELECT DISTINCT project, term FROM te) USING (project) WHERE contains(t, term)) WHERE f > 0),
dfs AS (SELECT project, term, count(*) AS df FROM tf GROUP BY ALL),
qi AS (SELECT te.*, total, mean, ln(1 + (total - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf FROM te JOIN st USING (project) LEFT JOIN dfs USING (project, term)),
wi AS (SELECT project, query_id, sum(idf) AS idf_sum FROM qi GROUP BY ALL),
sc AS (SELECT project, query_id, rel, symbol, line, name, sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length(t) / mean))) AS s, count(*) AS matched, sum(idf) AS covered FROM qi JOIN tf USING (project, term) GROUP BY ALL),
nd AS (SELECT sc.*, covered / idf_sum AS coverage, CASE WHEN symbol IS NULL THEN length(name) >= 4 AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), name) ELSE length(name) >= 5 AND contains(lower(text), name) END AS named
  FROM sc JOIN wi USING (project, query_id) JOIN ask USING (project, query_id)),
ga AS (SELECT *, round(s * CASE WHEN named THEN 3 WHEN symbol IS NULL THEN 0.8::DOUBLE ELSE 1 END, 9) AS score FROM nd WHERE named OR (matched >= 2 AND coverage >= 0.3::DOUBLE)),
pr AS (SELECT project, query_id, rel, max(score) AS score, coalesce(array_to_string((list(symbol || ' L' || line ORDER BY score DESC, line, symbol) FILTER (symbol IS NOT NULL))[1:3], ', '), '') AS symbols FROM ga GROUP BY ALL),
tn AS (SELECT *, row_number() OVER (PARTITION BY project, query_id ORDER BY score DESC, rel) AS nth FROM pr QUALIFY nth <= 5),
us AS (SELECT project, rel, array_to_string(list(DISTINCT target ORDER BY target)[1:3], ', ') AS uses FROM edges GROUP BY ALL)
SELECT project, query_id, CAST(nth AS INTEGER) AS nth, rel, p_size * 100 AS bytes, round(score, 6) AS score, symbols, coalesce(uses, '') AS uses FROM tn JOIN files USING (project, rel) LEFT JOIN us USING (project, rel)""",
)
def relevant_code(spark, d):
    df, symbols, imports = corpus(spark, d)
    last = F.max_by(F.split_part("p_name", F.lit(" "), F.lit(1)), "p_partkey")
    key = F.max("p_partkey")
    text = F.concat(F.lit("Fix "), last, F.lit(" of f"), key.cast("string"), F.lit(" and the index of a"), (key + 1).cast("string"))
    project = F.concat(F.lit("p"), (F.col("p_partkey") % 3).cast("string")).alias("project")
    ask = table(spark, d, "part").groupBy(project, F.col("p_brand").alias("query_id")).agg(text.alias("text"))
    out = hints.relevant_code(ask, df, symbols, imports)
    names = F.array_join(F.transform("symbols", lambda s: F.concat_ws(" L", s["symbol"], s["line"].cast("string"))), ", ")
    return out.select("project", "query_id", "nth", "rel", "bytes", F.round("score", 6).alias("score"), names.alias("symbols"), F.array_join("uses", ", ").alias("uses"))
