"""Upkeep of a memory graph of orders (sessions), parts (files), lineitems (touches) and document lines (notes)."""

from pyspark.sql import functions as F

from tracewell.operators import upkeep as U
from tracewell.plans import memory
from tracewell.plans.registry import query, table
from tracewell.session import work_path
from tracewell.sources.corpus import write_partitioned

PROJECTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GRAPH = f"""nodes AS (
  SELECT 's' || o_orderkey AS id, 'session' AS type, o_orderpriority AS project, 'order ' || o_orderkey AS label, o_orderdate AS created, o_orderdate AS updated, 1 + least(3, (o_orderkey % 7) / 4::DOUBLE) AS weight,
    o_orderkey % 5 AS touches, false AS pinned, false AS auto, NULL::VARCHAR AS kind, o_orderdate - to_days((o_orderkey % 20)::INT) AS started, o_orderkey % 7 AS prompt_count, NULL::BIGINT AS sessions, NULL::VARCHAR[] AS highlights FROM orders
  UNION ALL SELECT 'f' || p_partkey, 'file', {PROJECTS}[p_partkey % 5 + 1], p_name, TIMESTAMP '1995-01-01', TIMESTAMP '2001-06-01' + to_hours((p_partkey % 900)::INT), 1, 0, false, false, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'n' || doc_id, 'note', source, substr(string_split(text, chr(10))[1], 1, 200), TIMESTAMP '2001-01-01' + to_hours((doc_id % 4000)::INT), TIMESTAMP '2001-01-01' + to_hours((doc_id % 4000)::INT), 1.5, doc_id % 4, doc_id % 10 = 0,
    doc_id % 20 = 0, CASE doc_id % 3 WHEN 0 THEN 'cause' WHEN 1 THEN 'decision' END, NULL, NULL, NULL, NULL FROM documents
  UNION ALL SELECT 'digest:2-HIGH:1995-03', 'digest', '2-HIGH', 'old', TIMESTAMP '1995-03-01', TIMESTAMP '1995-03-02', 2.0, 4, false, false, NULL, NULL, 9, 3, ['first']),
edges AS (SELECT 's' || l_orderkey AS b, 'f' || l_partkey AS a, CAST(count(*) + 2*count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS w FROM lineitem GROUP BY ALL),
as_of AS (SELECT max(o_orderdate) AS now FROM orders)"""
SCORE = "(CASE WHEN type = 'project' THEN 'inf'::DOUBLE ELSE (weight + CASE WHEN pinned THEN 3 ELSE 0 END + ln(1 + touches)) * pow(0.5, greatest(0, (epoch_us(now) - epoch_us(updated)) / 86400e6::DOUBLE) / 14) END)"


def nodes(spark, d):
    key, part, doc = F.col("o_orderkey"), F.col("p_partkey"), F.col("doc_id")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda **c: [c.get(n, none(k)).cast(k).alias(n) for n, k in (x.split(" ", 1) for x in U.NODE.split(", "))]
    flat = {"pinned": F.lit(False), "auto": F.lit(False)}
    at = lambda day, hours: F.expr(f"timestamp_ntz'{day}'") + F.make_interval(hours=hours)
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    sessions = table(spark, d, "orders").select(*row(
        id=text("s", key), type=F.lit("session"), project=F.col("o_orderpriority"), label=text("order ", key), created=F.col("o_orderdate"), updated=F.col("o_orderdate"), weight=1 + F.least(F.lit(3.0), key % 7 / 4), touches=key % 5,
        started=F.col("o_orderdate") - F.make_interval(days=key % 20), prompt_count=key % 7, **flat))
    parts = table(spark, d, "part").select(*row(
        id=text("f", part), type=F.lit("file"), project=F.get(F.array(*map(F.lit, PROJECTS)), (part % 5).cast("int")), label=F.col("p_name"), created=F.expr("timestamp_ntz'1995-01-01'"), updated=at("2001-06-01", part % 900),
        weight=F.lit(1.0), touches=F.lit(0), **flat))
    notes = table(spark, d, "documents").select(*row(
        id=text("n", doc), type=F.lit("note"), project=F.col("source"), label=F.substring(F.get(F.split("text", "\n"), 0), 1, 200), created=at("2001-01-01", doc % 4000), updated=at("2001-01-01", doc % 4000), weight=F.lit(1.5), touches=doc % 4,
        pinned=doc % 10 == 0, auto=doc % 20 == 0, kind=F.when(doc % 3 == 0, "cause").when(doc % 3 == 1, "decision")))
    old = spark.range(1).select(*row(
        id=F.lit("digest:2-HIGH:1995-03"), type=F.lit("digest"), project=F.lit("2-HIGH"), label=F.lit("old"), created=F.expr("timestamp_ntz'1995-03-01'"), updated=F.expr("timestamp_ntz'1995-03-02'"), weight=F.lit(2.0), touches=F.lit(4),
        prompt_count=F.lit(9), sessions=F.lit(3), highlights=F.array(F.lit("first")), **flat))
    return sessions.unionByName(parts).unionByName(notes).unionByName(old)


def edges(spark, d):
    return memory.edges(spark, d).select(F.col("b").alias("a"), F.col("a").alias("b"), "w")


def as_of(spark, d):
    return F.lit(table(spark, d, "orders").agg(F.max("o_orderdate")).first()[0]).cast("timestamp_ntz")


DIGESTS = f"""{GRAPH},
old AS (SELECT nodes.*, 'digest:' || project || ':' || strftime(started, '%Y-%m') AS did, row_number() OVER (PARTITION BY 'digest:' || project || ':' || strftime(started, '%Y-%m') ORDER BY updated, id) AS nth
  FROM nodes, as_of WHERE type = 'session' AND epoch_us(now) - epoch_us(updated) >= 21 * 86400000000),
sums AS (SELECT did AS id, any_value(project) AS project, any_value(project || ' ' || strftime(started, '%Y-%m')) AS label, count(*) AS n, sum(prompt_count) AS p, sum(touches) AS t, max(updated) AS last, list(label ORDER BY nth) FILTER (nth <= 12) AS h FROM old GROUP BY did),
digests AS (SELECT id, coalesce(s.project, o.project) AS project, coalesce(s.label, o.label) AS label, greatest(o.updated, s.last) AS updated, CASE WHEN n IS NULL THEN o.weight ELSE least(5, 1 + (coalesce(o.sessions, 0) + n) / 5::DOUBLE) END AS weight,
  CAST(coalesce(o.touches, 0) + coalesce(t, 0) AS BIGINT) AS touches, CAST(coalesce(o.prompt_count, 0) + coalesce(p, 0) AS BIGINT) AS prompt_count, coalesce(o.sessions, 0) + coalesce(n, 0) AS sessions,
  array_to_string((coalesce(o.highlights, []) || coalesce(h, []))[1:12], '|') AS highlights FROM (FROM nodes WHERE type = 'digest') o FULL JOIN sums s USING (id))"""


@query("fold_digests", f"WITH {DIGESTS} SELECT * FROM digests")
def fold_digests(spark, d):
    now = as_of(spark, d)
    graph = U.fold_digests(*U.fold_digests(nodes(spark, d), edges(spark, d), now), now)  # the second run finds nothing
    digests = graph[0].where("type = 'digest'").withColumn("highlights", F.array_join("highlights", "|"))
    return digests.select("id", "project", "label", "updated", "weight", "touches", "prompt_count", "sessions", "highlights")


@query("fold_edges", f"WITH {DIGESTS} SELECT least(a, coalesce(did, b)) AS a, greatest(a, coalesce(did, b)) AS b, CAST(sum(w) AS BIGINT) AS w FROM edges LEFT JOIN (SELECT id, did FROM old) o ON o.id = b GROUP BY ALL")
def fold_edges(spark, d):
    return U.fold_digests(nodes(spark, d), edges(spark, d), as_of(spark, d))[1]


# every third session comes again, renamed and later; every order above the last one is new
@query(
    "upsert_nodes",
    f"""WITH {GRAPH}, batch AS (SELECT 's' || (o_orderkey + CASE WHEN o_orderkey % 6 = 0 THEN 10000000 ELSE 0 END) AS id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'again ' || o_orderkey END AS label, o_orderdate + to_days((o_orderkey % 5 - 2)::INT) AS updated,
  o_orderkey % 11 AS prompt_count, o_orderpriority AS project FROM orders WHERE o_orderkey % 3 = 0)
SELECT id, coalesce(o.project, n.project) AS project, coalesce(nullif(n.label, ''), o.label) AS label, coalesce(o.created, n.updated) AS created, greatest(o.updated, n.updated) AS updated, coalesce(o.weight, 1) AS weight, coalesce(o.touches, 0) AS touches,
  coalesce(n.prompt_count, o.prompt_count) AS prompt_count FROM (FROM nodes WHERE type = 'session') o FULL JOIN batch n USING (id)""",
)
def upsert_nodes(spark, d):
    key = F.col("o_orderkey")
    new = key + F.when(key % 6 == 0, 10_000_000).otherwise(0)
    batch = table(spark, d, "orders").where(key % 3 == 0).select(
        F.concat(F.lit("s"), new.cast("string")).alias("id"), F.lit("session").alias("type"), F.col("o_orderpriority").alias("project"), F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("again "), key.cast("string"))).alias("label"),
        (F.col("o_orderdate") + F.make_interval(days=key % 5 - 2)).alias("updated"), (key % 11).alias("prompt_count"),
    )
    sessions = nodes(spark, d).where("type = 'session'")
    twice = U.upsert_nodes(U.upsert_nodes(sessions, batch), batch)
    return twice.select("id", "project", "label", "created", "updated", "weight", "touches", "prompt_count")


@query(
    "replace_edges",
    f"""WITH {GRAPH} SELECT a, b, CASE WHEN CAST(substr(b, 2) AS BIGINT) % 3 = 0 THEN w * 2 ELSE w END AS w FROM edges WHERE NOT (CAST(substr(b, 2) AS BIGINT) % 3 = 0 AND CAST(substr(a, 2) AS BIGINT) % 2 = 1)""",
)
def replace_edges(spark, d):
    """Every third session is ingested again, twice, with the even files only and doubled weights."""
    e = edges(spark, d)
    again = F.substring("b", F.lit(2), F.char_length("b")).cast("bigint") % 3 == 0
    batch = e.where(again & (F.substring("a", F.lit(2), F.char_length("a")).cast("bigint") % 2 == 0)).withColumn("w", F.col("w") * 2)
    sessions = e.where(again).select(F.col("b").alias("id"))
    return U.replace_edges(U.replace_edges(e, batch, sessions), batch, sessions)


LEADERS = f"""{GRAPH},
m AS (SELECT id, project, list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+')) AS ws, row_number() OVER (PARTITION BY project ORDER BY created, id) AS i FROM nodes WHERE type = 'note'),
f(project, i, id, leader, kept) AS (
  SELECT project, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::STRUCT(id VARCHAR, ws VARCHAR[])[] FROM m WHERE i = 1
  UNION ALL SELECT m.project, m.i, m.id, coalesce(g.like_.id, m.id), CASE WHEN g.like_ IS NULL THEN list_append(f.kept, struct_pack(id := m.id, ws := m.ws)) ELSE f.kept END
  FROM f JOIN m ON m.project = f.project AND m.i = f.i + 1, LATERAL (SELECT list_filter(f.kept, lambda o: len(list_intersect(o.ws, m.ws)) > 0 AND len(list_intersect(o.ws, m.ws)) >= 0.6::DOUBLE * (len(o.ws) + len(m.ws) - len(list_intersect(o.ws, m.ws))))[1] AS like_) g)"""


@query("near_dup_notes", f"WITH RECURSIVE {LEADERS} SELECT id, leader FROM f WHERE i > 0")
def near_dup_notes(spark, d):
    return U.near_dup_notes(nodes(spark, d).where("type = 'note'"))


@query(
    "merge_notes",
    f"""WITH RECURSIVE {LEADERS}, j AS (SELECT n.*, leader FROM nodes n JOIN f USING (id))
SELECT leader AS id, arg_min(label, struct_pack(l := -length(label), c := created, i := id)) AS label, max(weight) AS weight, max(updated) AS updated, bool_or(pinned) AS pinned, CAST(sum(touches) + count(*) - 1 AS BIGINT) AS touches, any_value(kind) FILTER (id = leader) AS kind FROM j GROUP BY leader""",
)
def merge_notes(spark, d):
    merged, _ = U.merge_notes(nodes(spark, d).where("type = 'note'"), edges(spark, d).limit(0), rounds=1)
    return merged.select("id", "label", "weight", "updated", "pinned", "touches", "kind")


@query("decay_score", f"WITH {GRAPH} SELECT id, round({SCORE}, 9) AS score FROM nodes, as_of")
def decay_score(spark, d):
    return nodes(spark, d).select("id", F.round(U.decay_score(as_of(spark, d)), 9).alias("score"))


@query(
    "prune_nodes",
    f"""WITH {GRAPH},
p AS (SELECT *, pinned AND NOT (auto AND row_number() OVER (PARTITION BY project, type = 'note' AND pinned AND auto ORDER BY updated DESC, id) > 2) AS pin FROM nodes),
fa AS (SELECT * EXCLUDE (pinned, pin), pin AS pinned, type = 'note' AND kind IS NOT NULL AND NOT pin AS fact FROM p),
fb AS (SELECT *, row_number() OVER (PARTITION BY project, fact ORDER BY round({SCORE}, 9) DESC, id) AS fn FROM fa, as_of),
t AS (SELECT a AS id, sum(w) AS t, max(updated) AS u FROM edges JOIN (SELECT id, updated FROM nodes WHERE type = 'session') s ON s.id = b GROUP BY a),
fc AS (SELECT fb.* EXCLUDE (touches, updated), CASE WHEN type = 'file' THEN coalesce(t, 0) ELSE touches END AS touches, CASE WHEN type = 'file' THEN greatest(updated, u) ELSE updated END AS updated FROM fb LEFT JOIN t USING (id) WHERE NOT fact OR fn <= 12),
fd AS (SELECT *, type IN ('project', 'digest') OR pinned OR (type = 'session' AND epoch_us(now) - epoch_us(updated) < 2 * 86400000000) AS fixed, round({SCORE}, 9) AS score FROM fc),
fe AS (SELECT *, count(*) OVER (PARTITION BY project) AS total, count(*) FILTER (NOT fixed) OVER (PARTITION BY project) AS free, row_number() OVER (PARTITION BY project, fixed ORDER BY score DESC, id) AS nth FROM fd)
SELECT id, type, project, pinned, CAST(touches AS BIGINT) AS touches, updated FROM fe WHERE (total <= 400 OR fixed OR nth <= greatest(0, free - (total - 400))) AND NOT (type IN ('topic', 'file') AND score < 0.05)""",
)
def prune_nodes(spark, d):
    left = U.prune_nodes(U.cap_auto_pins(nodes(spark, d), 2), edges(spark, d), as_of(spark, d), most_facts=12)
    return left.select("id", "type", "project", "pinned", "touches", "updated")


@query("consolidate")
def consolidate(spark, d):
    return U.consolidate(nodes(spark, d), edges(spark, d), as_of(spark, d))[2]


@query(
    "pending_ingest",
    """WITH b AS (SELECT user_id AS session_id, max(ts) AS modified, user_id % 4 <> 0 AS usable FROM events GROUP BY user_id), n AS (SELECT max(ts) + INTERVAL 1 HOUR AS now, min(ts) AS since FROM events),
i AS (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN modified ELSE modified - INTERVAL 1 DAY END AS ingested_at FROM b WHERE session_id % 5 <> 0)
SELECT * FROM (SELECT session_id, CASE WHEN usable THEN 'ingest' WHEN epoch_us(now) - epoch_us(modified) > 7 * 86400000000 THEN 'drop' END AS action FROM b LEFT JOIN i USING (session_id), n
  WHERE epoch_us(now) - epoch_us(modified) >= 5400000000 AND (ingested_at IS NULL OR ingested_at < modified)) WHERE action IS NOT NULL""",
)
def pending_ingest(spark, d):
    events, user = table(spark, d, "events"), F.col("session_id")
    buffers = events.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("modified")).withColumn("usable", user % 4 != 0)
    ingested = buffers.where(user % 5 != 0).select("session_id", F.when(user % 3 == 0, F.col("modified")).otherwise(F.col("modified") - F.expr("INTERVAL 1 DAY")).alias("ingested_at"))
    now = F.lit(events.agg(F.max("ts") + F.expr("INTERVAL 1 HOUR")).first()[0]).cast("timestamp_ntz")
    return U.pending_ingest(buffers, ingested, now, 90)


@query(
    "graph_export",
    f"""WITH {GRAPH}, ways AS (SELECT a, b, w FROM edges UNION ALL SELECT b, a, w FROM edges),
r AS (SELECT ways.a AS id, label, row_number() OVER (PARTITION BY ways.a ORDER BY w DESC, ways.b) AS nth FROM ways JOIN nodes ON nodes.id = ways.b),
l AS (SELECT id, string_agg(label, '|' ORDER BY nth) AS links FROM r WHERE nth <= 40 GROUP BY id)
SELECT project, type, id, label, round({SCORE}, 2) AS score, coalesce(links, '') AS links FROM nodes LEFT JOIN l USING (id), as_of""",
)
def graph_export(spark, d):
    out = U.graph_export(nodes(spark, d), edges(spark, d), as_of(spark, d))
    path = work_path(spark, "graph")
    write_partitioned(out, path, "project", "type", fmt="json")
    back = spark.read.schema(out.schema).json(path)
    return back.select("project", "type", "id", "label", "score", F.array_join("links", "|").alias("links"))
