"""History search: live and archived conversations and documents as one history, benchmark passages as queries."""

from pyspark.sql import functions as F

from tracewell.operators import history as H
from tracewell.plans import search
from tracewell.plans.registry import query, table

NOW = "2024-03-01 00:00:00"
# every third conversation is live, all are archived, and the documents are another client's; words of the prose state decisions
DECISION = r"(^|[ \n])(that|les|die)[ ,]"
ITEMS = f"""conv AS (SELECT 'c' || conv_id || '-' || turn AS item_id, conv_id AS session_id, CASE role WHEN 'user' THEN 'you' WHEN 'assistant' THEN 'Claude' ELSE 'tool' END AS who,
  TIMESTAMP '2024-01-01' + to_hours((conv_id * 3 + turn)::INT) AS ts, text FROM conversations),
items AS (SELECT *, CASE WHEN session_id % 3 = 0 THEN 'live' ELSE 'archive' END AS origin FROM conv
  UNION ALL SELECT 'd' || doc_id, -1 - doc_id % 50, CASE WHEN doc_id % 4 = 0 THEN 'tool result' ELSE 'Claude' END, CASE WHEN doc_id % 7 > 0 THEN TIMESTAMP '2024-01-01' + to_hours((doc_id % 2000)::INT) END, text, 'foreign' FROM documents),
hist AS (SELECT item_id AS doc_id, text FROM items)"""


def items(spark, d):
    at = lambda hours: F.expr("timestamp_ntz'2024-01-01'") + F.make_interval(hours=hours)
    conv = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("item_id"), F.col("conv_id").alias("session_id"),
        F.when(F.col("role") == "user", "you").when(F.col("role") == "assistant", "Claude").otherwise("tool").alias("who"), at(F.col("conv_id") * 3 + F.col("turn")).alias("ts"), "text",
    )
    doc = F.col("doc_id")
    foreign = table(spark, d, "documents").select(
        F.concat(F.lit("d"), doc.cast("string")).alias("item_id"), (-1 - doc % 50).alias("session_id"), F.when(doc % 4 == 0, "tool result").otherwise("Claude").alias("who"),
        F.when(doc % 7 > 0, at(doc % 2000)).alias("ts"), "text",
    )
    return H.deep_union(conv.where("session_id % 3 = 0"), conv, foreign)


@query("history_deep_union", f"WITH {ITEMS} SELECT item_id, session_id, origin, who, ts, length(text) AS chars FROM items")
def history_deep_union(spark, d):
    return items(spark, d).select("item_id", "session_id", "origin", "who", "ts", F.length("text").cast("bigint").alias("chars"))


@query(
    "history_search",
    f"""WITH {ITEMS}, {search.CLAUSES}{search.RANK.replace("documents", "hist")}{search.BEST},
wt AS (SELECT item_id AS doc_id, session_id, who, ts, text, CASE who WHEN 'you' THEN 1.35::DOUBLE WHEN 'Claude' THEN 1 WHEN 'tool result' THEN 0.6 ELSE 0.5 END * CASE WHEN who <> 'tool result' AND regexp_matches(text, '{DECISION}') THEN 1.25::DOUBLE ELSE 1 END
  * (1 + 0.15::DOUBLE * exp(-coalesce(greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6::DOUBLE), 30) / 7)) AS w, round((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 60) AS m FROM items),
ex AS (SELECT query_id, doc_id, session_id, who, m, round(score * w, 6) AS score, CASE WHEN pos > 200 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(0, pos - 200) + 1, 600), '\\s+', ' ', 'g')) || CASE WHEN greatest(0, pos - 200) + 600 < length(text) THEN '…' ELSE '' END AS ex
  FROM best JOIN wt USING (doc_id)),
one AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY query_id, substr(ex, 1, 120) ORDER BY score DESC, doc_id) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM one QUALIFY rank <= 10),
ln AS (SELECT *, '- ' || CASE WHEN m IS NULL THEN '?' WHEN m < 60 THEN greatest(1, m)::BIGINT || 'm ago' WHEN m < 2880 THEN round(m / 60)::BIGINT || 'h ago' ELSE round(m / 1440)::BIGINT || 'd ago' END || ' · ' || who || ': ' || ex AS line FROM rk),
tk AS (SELECT *, sum(ceil(length(line) / CASE WHEN length(regexp_replace(line, '[^{{}}()\\[\\];=<>+\\-*/\\\\|&^%$#@!~`"'',.:]', '', 'g')) / length(line) > 0.08 THEN 3.2 ELSE 4.0 END) + 1) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ln)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id AS item_id, session_id, round(score, 5) AS score, line FROM tk WHERE used + 30 <= 2500""",
)
def history_search(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = H.history_search(items(spark, d), queries, F.lit(NOW).cast("timestamp_ntz"), decision=DECISION)
    return found.withColumn("score", F.round("score", 5))
