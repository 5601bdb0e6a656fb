"""Memory graph over orders (sessions), parts (files) and lineitem (touches); prompts of the conversations."""

from pyspark.sql import functions as F

from tracewell.operators import memory as M
from tracewell.operators.search import STOP
from tracewell.plans.registry import query, table

GRAPH = """nodes AS (SELECT 's' || o_orderkey AS id, 'session' AS type, o_orderpriority AS project, o_orderdate AS updated FROM orders
  UNION ALL SELECT 'f' || p_partkey, 'file', 'parts', TIMESTAMP '1995-01-01' FROM part),
edges AS (SELECT 's' || l_orderkey AS a, 'f' || l_partkey AS b, CAST(count(*) + 2*count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS w FROM lineitem GROUP BY ALL)"""
TWO_WAYS = ", ways AS (SELECT a, b, w FROM edges UNION ALL SELECT b, a, w FROM edges)"


def nodes(spark, d):
    orders = table(spark, d, "orders").select(F.concat(F.lit("s"), "o_orderkey").alias("id"), F.lit("session").alias("type"), F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("updated"))
    parts = table(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey").alias("id"), F.lit("file").alias("type"), F.lit("parts").alias("project"), F.lit("1995-01-01").cast("timestamp_ntz").alias("updated"))
    return orders.unionByName(parts)


def edges(spark, d):
    touches = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_orderkey").alias("a"), F.concat(F.lit("f"), "l_partkey").alias("b"), "l_returnflag")
    return M.session_files(touches, "a", "b", F.col("l_returnflag") == "R").withColumnRenamed("weight", "w")


@query("session_files", f"WITH {GRAPH} SELECT * FROM edges")
def session_files(spark, d):
    return edges(spark, d)


@query("graph_neighbors", f"WITH {GRAPH}{TWO_WAYS} SELECT ways.a, ways.b, w, type AS b_type FROM ways JOIN nodes ON ways.b = id")
def graph_neighbors(spark, d):
    return M.neighbors(edges(spark, d), nodes(spark, d))


# urgent sessions are gone, so their edges hang
@query("graph_sweep", f"WITH {GRAPH}, alive AS (SELECT id FROM nodes WHERE project <> '1-URGENT') SELECT * FROM edges WHERE a IN (FROM alive) AND b IN (FROM alive)")
def graph_sweep(spark, d):
    return M.sweep(edges(spark, d), nodes(spark, d).where("project <> '1-URGENT'"))


@query(
    "graph_touches",
    f"""WITH {GRAPH} SELECT f.id, f.type, f.project, CAST(coalesce(sum(w) FILTER (s.id IS NOT NULL), 0) AS BIGINT) AS touches, greatest(f.updated, max(s.updated)) AS updated
FROM nodes f LEFT JOIN edges ON b = f.id LEFT JOIN nodes s ON s.id = a WHERE f.type = 'file' GROUP BY f.id, f.type, f.project, f.updated""",
)
def graph_touches(spark, d):
    return M.graph_touches(edges(spark, d), nodes(spark, d))


@query("memory_pivot", f"WITH {GRAPH} SELECT project, count(*) FILTER (type = 'session') AS n_session, count(*) FILTER (type = 'file') AS n_file, max(updated) AS last_active FROM nodes GROUP BY 1")
def memory_pivot(spark, d):
    return M.memory_pivot(nodes(spark, d), ["session", "file"])


_STOP = ", ".join(f"'{w}'" for w in STOP)


@query(
    "trivial_prompts",
    f"""SELECT conv_id, turn, coalesce(regexp_matches(text, '{M.TRIVIAL}') OR starts_with(ltrim(text), '/')
  OR len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_./-]*'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({_STOP}))) < 3, true) AS trivial FROM conversations WHERE role = 'user'""",
)
def trivial_prompts(spark, d):
    prompts = table(spark, d, "conversations").where("role = 'user'")
    return prompts.select("conv_id", "turn", M.is_trivial(F.col("text")).alias("trivial"))


@query(
    "remember_notes",
    f"""SELECT * FROM (SELECT conv_id, turn, trim(nullif(regexp_extract(CASE WHEN turn % 4 = 0 THEN 'Remember: ' ELSE '' END || text, '{M.REMEMBER}', 1), '')) AS note FROM conversations WHERE role = 'user') WHERE note IS NOT NULL""",
)
def remember_notes(spark, d):
    text = F.concat(F.when(F.col("turn") % 4 == 0, "Remember: ").otherwise(""), "text")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", M.remember_note(text).alias("note")).where("note IS NOT NULL")


@query("guess_project", "SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN 'p' || conv_id % 7 END AS project FROM conversations")
def guess_project(spark, d):
    folder = F.concat(F.lit("/home/u/p"), F.col("conv_id") % 7)
    named = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Working directory: "), folder, F.lit("/\n"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("cwd="), folder, F.lit(" ")))
    return table(spark, d, "conversations").select("conv_id", "turn", M.guess_project(F.concat(F.coalesce(named, F.lit("")), "text")).alias("project"))


@query(
    "asof_reply_before",
    """WITH p AS (SELECT *, last_value(CASE WHEN role = 'assistant' AND trim(text) <> '' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reply_at FROM conversations)
SELECT p.conv_id, p.turn, reply_at, r.text AS reply FROM p LEFT JOIN conversations r ON r.conv_id = p.conv_id AND r.turn = reply_at WHERE p.role = 'user'""",
)
def asof_reply_before(spark, d):
    return M.reply_before(table(spark, d, "conversations"), "conv_id", "turn", F.floor(F.col("turn") / 64))
