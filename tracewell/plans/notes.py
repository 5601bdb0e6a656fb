"""Keywords and notes of the documents, first notes and hot files of the graph, archived texts, code files of a repository."""

from pyspark.sql import functions as F

from tracewell.operators import notes as N
from tracewell.operators import upkeep as U
from tracewell.operators.search import STOP
from tracewell.plans import upkeep
from tracewell.plans.registry import query, table
from tracewell.session import work_path
from tracewell.sources import corpus, transcripts

_STOP = ", ".join(f"'{w}'" for w in STOP)
# words of the invented prose stand for the English of the default rules
NOTE, NARRATION = r"(^| )(that|les|die)[ ,]", r"^(Et|In)"


@query(
    "keywords_topk",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{N.KEYWORDS}')) AS word, 1 AS p FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{N.IDENTIFIERS}')), 2 FROM documents),
s AS (SELECT doc_id, word, CAST(sum(p) AS BIGINT) AS n FROM w WHERE p = 2 OR word NOT IN ({_STOP}) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
)
def keywords_topk(spark, d):
    return N.keywords(table(spark, d, "documents"), "doc_id")


@query(
    "extract_notes",
    f"""WITH p AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(regexp_replace(s, '^[\\s\\-*#>\\d.)]+', ''))) AS s FROM documents),
n AS (SELECT doc_id, list_filter(s, lambda x: length(x) BETWEEN 30 AND 240 AND regexp_matches(x, '{NOTE}') AND NOT regexp_matches(x, '{NARRATION}'))[1:3] AS notes FROM p)
SELECT doc_id, unnest(notes) AS note FROM n""",
)
def extract_notes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(N.extract_notes(F.col("text"), NOTE, NARRATION)).alias("note"))


@query(
    "top_notes",
    f"""WITH {upkeep.GRAPH}, s AS (SELECT project, id, label, pinned, round({upkeep.SCORE}, 9) AS score FROM nodes, as_of WHERE type = 'note')
SELECT project, id, pinned, CAST(row_number() OVER (PARTITION BY project ORDER BY pinned DESC, score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 12""",
)
def top_notes(spark, d):
    return N.top_notes(upkeep.nodes(spark, d), upkeep.as_of(spark, d)).select("project", "id", "pinned", "rank")


@query(
    "hot_files",
    f"""WITH {upkeep.GRAPH}, t AS (SELECT a AS id, CAST(sum(w) AS BIGINT) AS touches, max(s.updated) AS u FROM edges JOIN nodes s ON s.id = b AND s.type = 'session' GROUP BY a),
f AS (SELECT project, n.id, label, t.touches, greatest(n.updated, u) AS updated FROM nodes n JOIN t USING (id) WHERE type = 'file')
SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY touches DESC, updated DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 12""",
)
def hot_files(spark, d):
    return N.hot_files(U.with_touches(upkeep.nodes(spark, d), upkeep.edges(spark, d)))


@query("archive_text", "SELECT CAST(conv_id % 5 AS INTEGER) AS project, conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 12 AND NOT regexp_matches(trim(text), '^The')")
def archive_text(spark, d):
    """Texts worth keeping, written by project and read back."""
    items = table(spark, d, "conversations").withColumn("project", F.col("conv_id") % 5)
    path = work_path(spark, "archive")
    corpus.write_partitioned(corpus.archive_text(items, f"{transcripts.NOISE}|^The"), path, "project")
    return spark.read.parquet(path).select(F.col("project").cast("int").alias("project"), "conv_id", "turn", "role", "text")


# files named by the part's number: code, and each kind that is left out
PATHS = ["src/a{k}.ts", "node_modules/x{k}.js", "img/p{k}.PNG", "conf/.env.k{k}", "lib/yarn.lock", "a/dist/b{k}.py", "distant/c{k}.go", "keys/id_rsa{k}"]


@query(
    "repo_scan_filter",
    """WITH f AS (SELECT p_partkey AS k, [%s][p_partkey %% 8 + 1] AS rel, p_partkey %% 24 = 6 AS nul FROM part) SELECT rel FROM f WHERE k %% 8 IN (0, 6) AND NOT nul""" % ", ".join("'" + p.replace("{k}", "' || p_partkey || '") + "'" for p in PATHS),
)
def repo_scan_filter(spark, d):
    k = F.col("p_partkey")
    names = [F.concat(F.lit(p.split("{k}")[0]), *([k.cast("string"), F.lit(p.split("{k}")[1])] if "{k}" in p else [])) for p in PATHS]
    text = F.when(k % 24 == 6, F.concat("p_name", F.char(F.lit(0)))).otherwise(F.col("p_name"))
    files = table(spark, d, "part").select(F.get(F.array(*names), (k % 8).cast("int")).alias("rel"), text.alias("text"))
    return corpus.code_files(files).select("rel")


# a file for each document, in a folder and of a name that its text has
FILES = "files AS (SELECT DISTINCT source AS project, 'src/' || split_part(text, ' ', 3) || '/' || split_part(text, ' ', 2) || '.ts' AS path FROM documents)"
NAMES = "nd AS (SELECT project, path, lower(split_part(path, '/', -1)) AS base, regexp_replace(lower(split_part(path, '/', -1)), '\\.[^.]+$', '') AS stem, lower(split_part(path, '/', -2)) AS dir FROM files)"
_GENERIC = ", ".join(f"'{w}'" for w in N.GENERIC)


@query(
    "notes_for_file",
    f"""WITH {upkeep.GRAPH}, {FILES}, {NAMES}, nn AS (SELECT DISTINCT project, path, unnest([base, CASE WHEN length(stem) >= 5 AND stem NOT IN ({_GENERIC}) THEN stem END, CASE WHEN length(dir) >= 5 AND dir NOT IN ({_GENERIC}) THEN dir || '/' END]) AS needle FROM nd),
un AS (SELECT DISTINCT project, needle FROM nn WHERE needle IS NOT NULL),
nt AS (SELECT project, id, updated, lower(label) AS label FROM nodes WHERE type = 'note' AND (pinned OR kind IN ('decision', 'cause'))),
hit AS (SELECT un.project, needle, id, updated FROM un JOIN nt ON nt.project = un.project AND contains(label, needle) AND regexp_matches(label, '(^|[^a-z0-9_])' || regexp_escape(needle))),
per AS (SELECT DISTINCT project, path, id, updated FROM nn JOIN hit USING (project, needle))
SELECT project, path, CAST(row_number() OVER (PARTITION BY project, path ORDER BY updated DESC, id) AS INTEGER) AS rank, id FROM per QUALIFY rank <= 2""",
)
def notes_for_file(spark, d):
    word = lambda n: F.coalesce(F.get(F.split("text", " "), n), F.lit(""))
    files = table(spark, d, "documents").select(F.col("source").alias("project"), F.concat(F.lit("src/"), word(2), F.lit("/"), word(1), F.lit(".ts")).alias("path"))
    return N.notes_for_file(files, upkeep.nodes(spark, d))


@query(
    "keyword_recall",
    f"""WITH {upkeep.GRAPH}, pr AS (SELECT c.conv_id || '-' || turn AS query_id, source AS project, c.text FROM conversations c JOIN documents ON doc_id = conv_id WHERE role = 'user'),
w AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '{N.KEYWORDS}')) AS word, 1 AS p FROM pr UNION ALL SELECT query_id, unnest(regexp_extract_all(text, '{N.IDENTIFIERS}')), 2 FROM pr),
s AS (SELECT query_id, word, sum(p) AS n FROM w WHERE p = 2 OR word NOT IN ({_STOP}) GROUP BY ALL),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, word) <= 8),
said AS (SELECT query_id, list_distinct(flatten(list(regexp_extract_all(lower(word), '[a-z0-9]+')))) AS a FROM k GROUP BY 1),
hy AS (SELECT id, project, lower(concat_ws(' ', label, kind)) AS hay, {upkeep.SCORE} AS worth FROM nodes, as_of),
hit AS (SELECT query_id, id, count(*) AS points FROM k JOIN pr USING (query_id) JOIN hy USING (project) WHERE contains(hay, lower(word)) GROUP BY ALL),
j AS (SELECT query_id, id, points, worth, a, list_distinct(regexp_extract_all(hay, '[a-z0-9]+')) AS b FROM hit JOIN said USING (query_id) JOIN hy USING (id)),
r AS (SELECT query_id, id, worth, points + 2 * coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0)::DOUBLE, 0) AS rel FROM j),
o AS (SELECT query_id, id, round(rel, 6) AS relevance, round(rel * (1 + worth), 6) AS score FROM r WHERE rel >= 1.5)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, relevance, score FROM o QUALIFY rank <= 6""",
)
def keyword_recall(spark, d):
    """What users say, in the project that the document of their conversation's number comes from."""
    nodes = upkeep.nodes(spark, d)
    projects = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("project"))
    said = table(spark, d, "conversations").where("role = 'user'").join(projects, "conv_id")
    prompts = said.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "project", "text")
    return N.keyword_recall(prompts, nodes.withColumn("hay", F.concat_ws(" ", "label", "kind")), upkeep.as_of(spark, d))


@query("session_brief")
def session_brief(spark, d):
    nodes = upkeep.nodes(spark, d).withColumn("outcome", F.when((F.col("type") == "session") & (F.col("touches") > 1), F.concat(F.lit("done with "), "label")))
    return N.session_brief(nodes, upkeep.as_of(spark, d))
