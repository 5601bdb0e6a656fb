"""Tool-output compaction queries over the document texts."""

from pyspark.sql import functions as F

from tracewell import rules as R
from tracewell.functions import text as T
from tracewell.operators import compaction as K
from tracewell.operators.budget import budget_prefix
from tracewell.plans import oracle as O
from tracewell.plans.registry import query, table
from tracewell.sources import bindings as B
from tracewell.sources import corpus as S


def docs(spark, d):
    return table(spark, d, "documents")


def block(key: str, size: int = 10_000):
    """Order blocks for running sums over ids."""
    return F.floor(F.col(key) / size)


@query(
    "token_estimate",
    """SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE ceil(length(text)/CASE WHEN
  length(regexp_replace(substr(text, 1, 4000), '[^{}()\\[\\];=<>+\\-*/\\\\|&^%$#@!~`"'',.:]', '', 'g'))/length(substr(text, 1, 4000))::DOUBLE > 0.08
  THEN 3.2::DOUBLE ELSE 4.0::DOUBLE END) END AS BIGINT) AS tokens FROM documents""",
)
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    "image_tokens",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN 0 ELSE p_size*40 END::DOUBLE AS w, floor(p_retailprice)::DOUBLE AS h FROM part),
s AS (SELECT *, least(1.0::DOUBLE, 1568/greatest(w, h), sqrt(1300000/(w*h))) AS s FROM p WHERE w > 0)
SELECT p_partkey, CAST(CASE WHEN w = 0 THEN 1500 ELSE greatest(60, floor(w*s*(h*s)/880 + 0.5)) END AS BIGINT) AS tokens FROM p LEFT JOIN (SELECT p_partkey, s FROM s) USING (p_partkey)""",
)
def image_tokens(spark, d):
    w = F.when(F.col("p_size") % 13 == 0, 0).otherwise(F.col("p_size") * 40)
    return table(spark, d, "part").select("p_partkey", T.image_tokens(w, F.floor("p_retailprice")).alias("tokens"))


@query(
    "collapse_runs",
    """WITH l AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, n, rtrim(raw, ' ' || chr(9)) AS line FROM l),
g AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS s FROM c),
r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
o AS (SELECT doc_id, run, any_value(line) AS line, count(*) AS n FROM r GROUP BY 1, 2),
p AS (SELECT doc_id, run, CASE WHEN n >= 3 AND trim(line) <> '' THEN line || '  [×' || n || ']' ELSE rtrim(repeat(line || chr(10), n), CASE WHEN line = '' THEN '' ELSE chr(10) END) END AS part, line, n FROM o),
q AS (SELECT doc_id, string_agg(CASE WHEN line = '' THEN repeat(chr(10), n - 1) ELSE part END, chr(10) ORDER BY run) AS t FROM p GROUP BY 1)
SELECT doc_id, CASE WHEN length(text) < 400 THEN text ELSE regexp_replace(t, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g') END AS collapsed FROM documents JOIN q USING (doc_id)""",
)
def collapse_runs(spark, d):
    return K.collapse_runs(docs(spark, d)).select("doc_id", "collapsed")


WORDS = "(^|[^a-z])(that|les|der)([^a-z]|$)"


@query(
    "head_tail_cut",
    f"""WITH t AS (SELECT doc_id, text, length(text) AS n, instr(reverse(substr(text, 1, 1501)), chr(10)) AS b, instr(substr(text, length(text) - 999), chr(10)) AS f FROM documents),
h AS (SELECT *, CASE WHEN b > 0 AND 1501 - b > 0 THEN 1501 - b ELSE 1500 END AS h, CASE WHEN f > 0 THEN n - 1000 + f - 1 ELSE -1 END AS ts FROM t WHERE n > 4000),
s AS (SELECT *, CASE WHEN ts > h THEN ts ELSE n - 1000 END AS s FROM h),
c AS (SELECT *, string_split(substr(text, h + 1, s - h), chr(10)) AS ls FROM s),
k AS (SELECT *, list_transform(list_filter(ls, lambda x: regexp_matches(x, '{WORDS}'))[1:20], lambda x: CASE WHEN length(x) > 300 THEN substr(x, 1, 300) || '…' ELSE x END) AS kept FROM c)
SELECT doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE substr(k.text, 1, h) || chr(10) || chr(10) || '[' || len(ls) || ' lines (' || (s - h) || ' chars) hidden]' || chr(10)
  || CASE WHEN len(kept) > 0 THEN '[problem lines from the hidden part]' || chr(10) || array_to_string(kept, chr(10)) || chr(10) ELSE '' END || chr(10) || substr(k.text, s + 1) END AS cut
FROM documents d LEFT JOIN k USING (doc_id)""",
)
def head_tail_cut(spark, d):
    return K.head_tail_cut(docs(spark, d), threshold=4000, head=1500, tail=1000, problem=WORDS).select("doc_id", "cut")


def build_output(spark, d):
    """Texts with some indented lines and blank pairs, as test and build output has."""
    t = F.regexp_replace("text", r"(?m)^([E-H])", "  $1")
    return docs(spark, d).select("doc_id", "source", F.regexp_replace(t, r"\.\nO", ".\n\n\nO").alias("text"))


BUILD = """b AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, '(?m)^([E-H])', '  \\1', 'g'), '\\.\\nO', '.' || chr(10) || chr(10) || chr(10) || 'O', 'g') AS text FROM documents)"""
PROSE_RUNNERS = [("prose", r"(?m)^The "), ("deutsch", r"(?m)^D"), ("other", r"(?m)^L")]


@query(
    "test_summary",
    f"""WITH {BUILD},
r AS (SELECT doc_id, text, length(text) AS chars, string_split(text, chr(10)) AS ls, CASE WHEN regexp_matches(text, '(?m)^The ') THEN 'prose' WHEN regexp_matches(text, '(?m)^D') THEN 'deutsch'
  WHEN regexp_matches(text, '(?m)^L') THEN 'other' END AS framework FROM b WHERE length(text) >= 1000),
l AS (SELECT doc_id, framework, chars, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM r WHERE framework IS NOT NULL),
m AS (SELECT *, regexp_matches(line, '^[A-D]') AS ok, regexp_matches(line, 'that|que|und') AND NOT regexp_matches(line, '^[A-D]') AS bad,
  trim(line) = '' AS blank, coalesce(trim(lead(line) OVER (PARTITION BY doc_id ORDER BY i)) = '', true) AS blank2,
  regexp_matches(line, '^\\s+\\S') AND NOT regexp_matches(line, '^[A-D]') AS walks, regexp_matches(line, '^\\s*(={{10,}}|-{{10,}}|_{{10,}})') AS rule FROM l),
k AS (SELECT m.*, (i < 3 AND NOT blank) OR (regexp_matches(line, 'les|of') AND (i >= n - 40 OR regexp_matches(line, '^(The|La)')))
  OR EXISTS (SELECT 1 FROM m f WHERE f.doc_id = m.doc_id AND f.bad AND f.i <= m.i AND m.i - f.i < 40 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.doc_id = m.doc_id AND x.i <= m.i
      AND ((x.i > f.i AND (x.ok OR x.rule)) OR (x.i > f.i + 1 AND x.blank AND x.blank2))))
  OR (walks AND EXISTS (SELECT 1 FROM m f WHERE f.doc_id = m.doc_id AND f.bad AND f.i > m.i AND f.i - m.i <= 30
      AND NOT EXISTS (SELECT 1 FROM m x WHERE x.doc_id = m.doc_id AND x.i > m.i AND x.i < f.i AND NOT x.walks))) AS keep FROM m),
g AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM k WHERE keep),
o AS (SELECT g.*, CASE WHEN i - p > 1 THEN '  … ' || (i - p - 1) || ' line(s) omitted' || CASE WHEN (SELECT count(*) FROM m x WHERE x.doc_id = g.doc_id AND x.i > g.p AND x.i < g.i AND x.ok) > 0
    THEN ' (' || (SELECT count(*) FROM m x WHERE x.doc_id = g.doc_id AND x.i > g.p AND x.i < g.i AND x.ok) || ' passing)' ELSE '' END || chr(10) ELSE '' END || line AS part FROM g),
s AS (SELECT doc_id, any_value(framework) AS framework, any_value(chars) AS chars, any_value(n) AS n, count(*) AS kept, count(*) FILTER (bad) AS failures, max(i) AS last,
  string_agg(part, chr(10) ORDER BY i) AS body FROM o GROUP BY 1),
t AS (SELECT *, body || CASE WHEN last < n - 1 THEN chr(10) || '  … ' || (n - 1 - last) || ' line(s) omitted' ELSE '' END AS body1 FROM s)
SELECT doc_id, framework, length(body1) <= chars*0.7 AS changed, failures, kept AS kept_lines, n AS total_lines, 0::BIGINT AS hidden_chars, CASE WHEN length(body1) <= chars*0.7 THEN '[' || framework || ' output: '
  || failures || ' failing line(s); ' || (n - kept) || ' other line(s) left out]' || chr(10) || body1 END AS summary FROM t""",
)
def test_summary(spark, d):
    lines = K.test_lines(
        build_output(spark, d), "doc_id", runners=PROSE_RUNNERS, passed="^[A-D]", failed="that|que|und", summary="les|of", header="^(The|La)", min_chars=1000
    )
    return K.test_summary(lines, "doc_id")


PROSE_RULES = [("prose", r"^(npm|git|cargo)\b", ["^[A-H]", "de "], "^T.*the")]


def with_command(df):
    cmds = F.array(*[F.lit(c[0]) for c in B.COMMANDS])
    return df.withColumn("command", F.get(cmds, (F.col("doc_id") % len(B.COMMANDS)).cast("int")))


@query(
    "cmd_rules",
    O.with_(
        O.CALLS.split(",\ncalls AS")[0] + ", " + BUILD,
        """, c AS (SELECT b.*, command, family, regexp_matches(command, '^(npm|git|cargo)\\b') AS hit FROM b JOIN cmds ON doc_id % 20 = i),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c WHERE hit AND length(text) >= 300),
k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^T.*the') THEN 'sample'
  WHEN regexp_matches(line, '^[A-H]|de ') AND NOT regexp_matches(line, 'that|nicht') THEN 'noise' ELSE 'keep' END AS c FROM l),
v AS (SELECT *, CASE WHEN c = 'keep' OR c IS DISTINCT FROM lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS st FROM k WHERE c <> 'sample'),
w AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM v),
x AS (SELECT doc_id, g, any_value(c) AS c, any_value(line) AS line, count(*) AS n FROM w GROUP BY 1, 2),
y AS (SELECT doc_id, string_agg(CASE c WHEN 'noise' THEN '  … ' || n || ' progress line' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' omitted' WHEN 'blank' THEN '' ELSE line END, chr(10) ORDER BY g) AS body FROM x GROUP BY 1),
s AS (SELECT doc_id, count(*) FILTER (c IN ('sample','noise')) AS dropped, count(*) FILTER (c = 'sample') AS ns, array_to_string((list(line ORDER BY i) FILTER (c = 'sample'))[1:3], chr(10)) AS sl FROM k GROUP BY 1),
z AS (SELECT s.doc_id, dropped, trim(coalesce(body, ''), chr(10)) || CASE WHEN ns > 0 THEN chr(10) || chr(10) || '[' || ns || ' notices; first ' || least(ns, 3) || ':]' || chr(10) || sl ELSE '' END AS body FROM s LEFT JOIN y USING (doc_id)),
q AS (SELECT doc_id, dropped, ltrim(body, chr(10)) AS body FROM z)
SELECT c.doc_id, coalesce(c.family, '') AS family, CASE WHEN q.dropped >= 5 AND length(q.body) <= length(c.text)*0.75 THEN q.dropped ELSE 0 END AS dropped,
  CASE WHEN q.dropped >= 5 AND length(q.body) <= length(c.text)*0.75 THEN '[prose output: ' || q.dropped || ' progress/notice lines dropped, errors and warnings kept]' || chr(10) || q.body ELSE c.text END AS quiet
FROM c LEFT JOIN q USING (doc_id)""",
    ),
)
def cmd_rules(spark, d):
    df = with_command(build_output(spark, d))
    df = df.withColumns(
        {
            "family": F.array_join(K.command_families(F.col("command")), "/"),
            "families": K.command_families(F.col("command"), PROSE_RULES),
        }
    )
    out = K.drop_command_noise(df, rules=PROSE_RULES, guard="that|nicht", min_chars=300)
    return out.select("doc_id", "family", "dropped", "quiet")


@query(
    "compaction_chain",
    O.with_(
        O.CALLS.split(",\ncalls AS")[0],
        """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, rtrim(raw, ' ') AS line FROM l),
g AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS s FROM c),
r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
o AS (SELECT doc_id, run, any_value(line) AS line, count(*) AS n FROM r GROUP BY 1, 2),
q AS (SELECT doc_id, string_agg(CASE WHEN n >= 3 AND trim(line) <> '' THEN line || '  [×' || n || ']' ELSE array_to_string(list_transform(range(n), lambda z: line), chr(10)) END, chr(10) ORDER BY run) AS t FROM o GROUP BY 1),
t AS (SELECT d.doc_id, d.text AS orig, CASE WHEN length(d.text) < 400 THEN d.text ELSE regexp_replace(t, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g') END AS text,
  CASE WHEN content THEN 24000 ELSE 9000 END AS lim FROM documents d JOIN q USING (doc_id) JOIN cmds ON d.doc_id % 20 = cmds.i),
e AS (SELECT *, length(text) AS n, instr(reverse(substr(text, 1, 4501)), chr(10)) AS b, instr(substr(text, length(text) - 2999), chr(10)) AS f FROM t),
h AS (SELECT *, CASE WHEN b > 0 AND 4501 - b > 0 THEN 4501 - b ELSE 4500 END AS h, CASE WHEN f > 0 THEN n - 3000 + f - 1 ELSE -1 END AS ts FROM e),
s AS (SELECT *, CASE WHEN ts > h THEN ts ELSE n - 3000 END AS s FROM h),
x AS (SELECT doc_id, orig, CASE WHEN n > lim THEN substr(text, 1, h) || chr(10) || chr(10) || '[' || len(string_split(substr(text, h + 1, s - h), chr(10))) || ' lines (' || (s - h) || ' chars) hidden]' || chr(10)
  || chr(10) || substr(text, s + 1) ELSE text END AS short FROM s)
SELECT doc_id, 'trim' AS kind, length(orig) - length(short) AS removed_chars, CAST(round((length(orig) - length(short))/3.6::DOUBLE) AS BIGINT) AS saved_tokens, md5(short) AS short_md5
FROM x WHERE length(orig) - length(short) >= 200""",
    ),
)
def compaction_chain(spark, d):
    out = K.compaction_chain(with_command(docs(spark, d).select("doc_id", "text")), "doc_id")
    return out.select("doc_id", "kind", "removed_chars", "saved_tokens", F.md5("short").alias("short_md5"))


@query(
    "failure_clusters",
    f"""WITH {BUILD},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b),
m AS (SELECT *, regexp_matches(line, '{WORDS}') AS bad, lag(regexp_matches(line, '{WORDS}')) OVER (PARTITION BY doc_id ORDER BY i) AS pbad,
  row_number() OVER (PARTITION BY doc_id, trim(line) <> '' ORDER BY i DESC) AS back FROM l),
h AS (SELECT doc_id, bool_or(bad) AS any_bad FROM m GROUP BY 1),
q AS (SELECT m.doc_id, CASE WHEN any_bad THEN rtrim(line) ELSE line END AS line, i, any_bad OR back <= 25 AS shown FROM m JOIN h USING (doc_id)
  WHERE CASE WHEN any_bad THEN bad OR (coalesce(pbad, false) AND regexp_matches(line, '^\\s+\\S')) ELSE trim(line) <> '' END),
p AS (SELECT doc_id, line, min(i) AS i, min(i) FILTER (shown) AS si FROM q GROUP BY 1, 2),
e AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS a, string_agg(line, chr(10) ORDER BY si) FILTER (si IS NOT NULL) AS e FROM p GROUP BY 1),
x AS (SELECT b.doc_id, coalesce(a, '') AS a, CASE WHEN length(e) > 1800 THEN substr(e, 1, 1080) || chr(10) || '…' || chr(10) || right(e, 630) ELSE coalesce(e, '') END AS excerpt FROM b LEFT JOIN e USING (doc_id)),
f AS (SELECT *, substr(sha1(regexp_replace(regexp_replace(a, '[0-9]+(\\.[0-9]+)?\\s*(ms|s)\\b', '', 'g'), '[0-9]+', '#', 'g')), 1, 12) AS fp FROM x)
SELECT fp, count(*) AS n, min(doc_id) AS first_id, arg_min(excerpt, doc_id) AS excerpt FROM f GROUP BY fp""",
)
def failure_clusters(spark, d):
    return K.failure_clusters(build_output(spark, d), "doc_id", failing=WORDS)


def error_lines(spark, d):
    li = table(spark, d, "lineitem")
    text = F.concat(
        F.lit("src/f"), (F.col("l_partkey") % 40).cast("string"), F.lit(".ts("), F.col("l_linenumber").cast("string"), F.lit(","),
        F.col("l_quantity").cast("int").cast("string"), F.lit("): error TS"), (F.col("l_partkey") % 9 + 1000).cast("string"), F.lit(": bad "), "l_returnflag",
    )
    text = F.when(F.col("l_linestatus") == "F", text).otherwise(F.concat(F.lit("note "), text))
    return li.select(F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("pos"), text.alias("line"), "*")


@query(
    "compiler_errors",
    """WITH e AS (SELECT l_suppkey AS run_id, CASE WHEN l_linestatus = 'F' THEN '' ELSE 'note ' END || 'src/f' || (l_partkey % 40) || '.ts' AS file FROM lineitem),
p AS (SELECT run_id, file, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS total, greatest(0, count(*) - 15) AS more_files FROM p GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, file) AS rank FROM p)
SELECT run_id, file, n, rank, total, more_files FROM r JOIN t USING (run_id) WHERE rank <= 15 AND total > 40""",
)
def compiler_errors(spark, d):
    return K.compiler_errors(error_lines(spark, d), "run_id")


@query(
    "new_errors",
    """WITH e AS (SELECT l_partkey % 200 AS grp, 'f' || (l_partkey % 200) AS file, 'TS' || (l_suppkey % 10) AS code, l_returnflag || l_linenumber || floor(l_discount*100)::INT AS message,
  l_orderkey AS line, l_linestatus FROM lineitem),
n AS (SELECT * FROM e a WHERE l_linestatus = 'F' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.l_linestatus = 'O' AND b.file = a.file AND b.code = a.code AND b.message = a.message)),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY line, code, message) AS nth, count(*) OVER (PARTITION BY grp) AS n_new FROM n)
SELECT file, code, message, line, nth, n_new, greatest(0, n_new - 6) AS more FROM r WHERE nth <= 6""",
)
def new_errors(spark, d):
    from tracewell.operators.behaviour import new_errors as op

    li = table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 200).alias("grp"), F.concat(F.lit("f"), (F.col("l_partkey") % 200).cast("string")).alias("file"),
        F.concat(F.lit("TS"), (F.col("l_suppkey") % 10).cast("string")).alias("code"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.floor(F.col("l_discount") * 100).cast("int").cast("string")).alias("message"),
        F.col("l_orderkey").alias("line"), "l_linestatus",
    )
    out = op(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'"))
    return out.select("file", "code", "message", "line", "nth", "n_new", "more")


def order_lists(spark, d):
    """Orders of ten neighbouring customers as one JSON array text."""
    item = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("").alias("note"), F.lit(None).cast("string").alias("parent"),
        F.col("o_orderstatus").alias("state"), F.lit("https://x/a").alias("avatar_url"),
        F.concat(F.lit("https://x/o/"), F.col("o_orderkey").cast("string")).alias("html_url"), F.lit("padding padding padding padding").alias("body"),
    )
    groups = table(spark, d, "orders").groupBy(F.floor(F.col("o_custkey") / 10).alias("list_id"))
    rows = groups.agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("rows"))
    text = F.to_json(F.transform("rows", lambda r: r["item"]), {"ignoreNullFields": "false"})
    return rows.select("list_id", F.when(F.col("list_id") % 2 == 0, text).otherwise(F.concat(F.lit('{"total":1,"tags":["a"],"items":'), text, F.lit("}"))).alias("text"))


@query(
    "json_compact",
    """WITH r AS (SELECT *, CAST(floor(o_custkey/10) AS BIGINT) AS list_id, row_number() OVER (PARTITION BY floor(o_custkey/10) ORDER BY o_orderkey) AS i FROM orders),
n AS (SELECT list_id, count(*) AS n_items FROM r GROUP BY 1),
h AS (SELECT list_id, string_agg('id=' || o_orderkey || ' title=' || o_orderpriority || ' state=' || o_orderstatus || ' html_url=https://x/o/' || o_orderkey || ' body=padding padding padding padding', chr(10) ORDER BY i) AS head
  FROM r WHERE i <= 3 GROUP BY 1),
l AS (SELECT list_id, string_agg('  id=' || o_orderkey || ' title=' || o_orderpriority || ' state=' || o_orderstatus || ' html_url=https://x/o/' || o_orderkey, chr(10) ORDER BY i) AS listed
  FROM r WHERE i > 3 AND i <= 123 GROUP BY 1)
SELECT list_id, n_items, head, listed || CASE WHEN n_items > 123 THEN chr(10) || '  … and ' || (n_items - 123) || ' more' ELSE '' END AS listed, true AS changed
FROM n JOIN h USING (list_id) JOIN l USING (list_id) WHERE n_items >= 20""",
)
def json_compact(spark, d):
    return K.json_compact(order_lists(spark, d), min_chars=1000).select("list_id", "n_items", "head", "listed", "changed")


@query("filler_strip")
def filler_strip(spark, d):
    return K.filler_report(docs(spark, d), "source")


SQUEEZE = 600


@query(
    "squeeze_text",
    f"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s{{0,3}}#{{1,6}}\\s+', '', 'g'), '\\*\\*|__', '', 'g'),
  '(?m)^\\s*(?:[-*•]|\\d+[.)])\\s+', '· ', 'g'), '\\s+', ' ', 'g')) AS p FROM documents),
s AS (SELECT doc_id, list_filter(string_split(replace(regexp_replace(p, '([.!?:;])\\s+', '\\1' || chr(1), 'g'), '· ', chr(1) || '· '), chr(1)), lambda x: x <> '') AS ss FROM p WHERE length(p) > {SQUEEZE}),
u AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM s),
f AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM u),
h AS (SELECT doc_id, count(*) FILTER (run <= 330) AS hn, string_agg(x, ' ' ORDER BY i) FILTER (run <= 330) AS head FROM f GROUP BY 1),
b AS (SELECT u.*, hn, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i DESC) AS run FROM u JOIN h USING (doc_id) WHERE i > hn),
t AS (SELECT doc_id, count(*) FILTER (run <= 265) AS tn, string_agg(x, ' ' ORDER BY i) FILTER (run <= 265) AS tail FROM b GROUP BY 1),
e AS (SELECT doc_id, arg_min(x, i) AS first, arg_max(x, i) AS last, any_value(n) AS n FROM u GROUP BY 1),
j AS (SELECT e.*, coalesce(hn, 0) AS hn, head, coalesce(tn, 0) AS tn, tail, substr(first, 1, 330) AS fy, right(last, 265) AS ly FROM e JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)),
c AS (SELECT *, CASE WHEN length(first) <= 330 THEN first ELSE CASE WHEN instr(reverse(fy), ' ') > 0 AND 330 - instr(reverse(fy), ' ') > 165 THEN substr(fy, 1, 330 - instr(reverse(fy), ' ')) ELSE fy END || '…' END AS fc,
  CASE WHEN length(last) <= 265 THEN last ELSE '…' || CASE WHEN instr(ly, ' ') > 0 AND instr(ly, ' ') - 1 < 132.5 THEN substr(ly, instr(ly, ' ') + 1) ELSE ly END END AS lc FROM j)
SELECT doc_id, CASE WHEN c.doc_id IS NULL THEN p ELSE CASE WHEN hn > 0 THEN head ELSE fc END || CASE WHEN hn = 0 OR tn = 0 OR n - greatest(hn, 1) - greatest(tn, 1) > 0 THEN ' […] ' ELSE ' ' END
  || CASE WHEN tn > 0 THEN tail ELSE lc END END AS squeezed FROM p LEFT JOIN c USING (doc_id)""",
)
def squeeze_text(spark, d):
    return K.squeeze_text(docs(spark, d), SQUEEZE).select("doc_id", "squeezed")


@query(
    "corpus_grep",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
m AS (SELECT l.* FROM l JOIN documents d USING (doc_id) WHERE regexp_matches(d.source, '^src[0-4]$') AND regexp_matches(line, '(?i)ting[a-z]* on|^anti [a-z]|the[.]$'))
SELECT 'grep' AS op, doc_id, line_no, line, greatest(0, (SELECT count(*) FROM m) - 100) AS more FROM (SELECT * FROM m ORDER BY doc_id, line_no LIMIT 100)
UNION ALL SELECT 'read', doc_id, line_no, line, 0 FROM l WHERE line_no BETWEEN 2 AND 4""",
)
def corpus_grep(spark, d):
    some = docs(spark, d).filter(F.col("source").rlike("^src[0-4]$"))
    found = K.grep_lines(some, "doc_id", r"ting[a-z]* on|^anti [a-z]|the[.]$").withColumn("op", F.lit("grep"))
    part = K.read_lines(docs(spark, d), "doc_id", 2, 4).withColumns({"op": F.lit("read"), "more": F.lit(0).cast("bigint")})
    return found.unionByName(part)


@query(
    "budget_prefix",
    """WITH c AS (SELECT source, doc_id, CAST(ceil(n_chars/4.0) AS BIGINT) AS cost FROM documents),
r AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM c)
SELECT source, doc_id, cost, CAST(used AS BIGINT) AS used FROM r WHERE used <= 20000""",
)
def budget_prefix_query(spark, d):
    costs = docs(spark, d).select("source", "doc_id", F.ceil(F.col("n_chars") / 4).cast("bigint").alias("cost"))
    return budget_prefix(costs, ["source"], ["doc_id"], "cost", 20_000, block("doc_id"))


@query(
    "archive_prune",
    """WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS kept FROM documents)
SELECT source, doc_id, n_chars AS bytes, CAST(kept AS BIGINT) AS total FROM r WHERE kept <= 80000""",
)
def archive_prune(spark, d):
    sessions = docs(spark, d).select(F.col("source").alias("project"), F.col("doc_id").alias("session_id"), F.col("n_chars").alias("bytes"))
    out = S.archive_keep(sessions, order="session_id", max_bytes=80_000, bucket=block("session_id"))
    return out.select(F.col("project").alias("source"), F.col("session_id").alias("doc_id"), "bytes", "total")


@query(
    "project_key",
    """SELECT source, lang, source || '~' || substr(sha1('/w/' || lang || '/' || source), 1, 6) AS project, regexp_replace('/w/' || lang || '/' || source, '[^a-zA-Z0-9-]', '-', 'g') AS dir_key,
  count(*) AS n FROM documents GROUP BY 1, 2""",
)
def project_key(spark, d):
    per = docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    cwd = F.concat_ws("/", F.lit("/w"), "lang", "source")
    return per.select("source", "lang", S.project_key(cwd).alias("project"), S.transcript_dir_key(cwd).alias("dir_key"), "n")


@query(
    "private_scrub",
    """WITH w AS (SELECT doc_id, replace(text, ' the ', ' <private>the</private> ') || CASE WHEN doc_id % 10 = 0 THEN chr(10) || '<PRIVATE>' || substr(text, 1, 50) ELSE '' END AS text FROM documents)
SELECT doc_id, regexp_replace(text, '(?is)<private>.*?(?:</private>|\\z)', '[private]', 'g') AS text FROM w""",
)
def private_scrub(spark, d):
    wrapped = F.replace("text", F.lit(" the "), F.lit(" <private>the</private> "))
    open_ = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("\n<PRIVATE>"), F.substring("text", 1, 50))).otherwise("")
    df = docs(spark, d).select("doc_id", F.concat(wrapped, open_).alias("text"))
    return df.select("doc_id", S.scrub_private(F.col("text")).alias("text"))


_SECRET_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS pattern, count(*) AS lines FROM l WHERE regexp_matches(line, '{p}')" for name, p in R.SECRET_PATTERNS
)
_ANY_SECRET = " OR ".join(f"regexp_matches(line, '{p}')" for _, p in R.SECRET_PATTERNS)


@query(
    "secret_filter",
    f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
{_SECRET_SQL} UNION ALL SELECT 'clean', count(*) FROM l WHERE NOT ({_ANY_SECRET})""",
)
def secret_filter(spark, d):
    return S.secret_counts(docs(spark, d))
