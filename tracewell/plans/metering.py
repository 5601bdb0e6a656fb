"""Metering queries."""

from pyspark.sql import functions as F

from tracewell.functions.text import token_estimate
from tracewell.operators import metering as M
from tracewell.plans import oracle as O
from tracewell.plans.registry import query
from tracewell.sources import bindings as B


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def lines_of_replies(spark, d):
    """Each reply written as one to three transcript lines."""
    return B.replies(spark, d).select("*", F.explode(F.sequence(F.lit(1), (F.col("k") % 3 + 1).cast("int"))).alias("seq"))


@query(
    "dedupe_replies",
    O.with_(
        O.REPLIES,
        """SELECT session_id, msg_id, model, output_tokens, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, msg_id ORDER BY seq DESC) AS rn
  FROM (SELECT *, CAST(unnest(range(1, k % 3 + 2)) AS BIGINT) AS seq FROM replies)) WHERE rn = 1""",
    ),
)
def dedupe_replies(spark, d):
    out = M.dedupe_replies(lines_of_replies(spark, d))
    return out.select("session_id", "msg_id", "model", "output_tokens", F.col("seq").cast("bigint").alias("seq"))


@query(
    "request_cost",
    O.with_(O.COSTED, "SELECT msg_id, round(cost_usd, 9) AS cost_usd, round(cache_saved_usd, 9) AS cache_saved_usd FROM costed"),
)
def request_cost(spark, d):
    out = M.with_cost(B.replies(spark, d)).select("msg_id", "cost_usd", "cache_saved_usd")
    return rounded(out, "cost_usd", "cache_saved_usd", digits=9)


_VARIANT = (
    "CASE k % 6 WHEN 0 THEN 'us.anthropic.' || model WHEN 1 THEN 'gemini-3-flash' WHEN 2 THEN 'gemini-3-' || event_type"
    " WHEN 3 THEN event_type WHEN 4 THEN 'claude-opus-' || event_type ELSE model END"
)


@query(
    "price_lookup",
    O.with_(
        O.REPLIES + f", named AS (SELECT {_VARIANT} AS model FROM replies), " + O.PRICES + ", " + O.model_price("named"),
        "SELECT model, p_in AS input_price, p_out AS output_price, count(*) AS n FROM named JOIN mp USING (model) GROUP BY ALL",
    ),
)
def price_lookup(spark, d):
    named = B.replies(spark, d).select(F.expr(_VARIANT).alias("model"))
    counted = named.groupBy("model").agg(F.count("*").alias("n"))
    m = F.col("model")
    return counted.select("model", M.P.input_price(m).alias("input_price"), M.P.output_price(m).alias("output_price"), "n")


_SUMS = "count(*) AS requests, round(sum(cost_usd),6) AS cost_usd"


@query(
    "usage_by_model",
    O.with_(
        O.COSTED,
        f"""SELECT model, {_SUMS}, round(sum(cache_saved_usd),6) AS cache_saved_usd,
  round(sum(cache_read)::DOUBLE/sum(ctx), 6) AS cache_hit_rate FROM costed GROUP BY model""",
    ),
)
def usage_by_model(spark, d):
    lines = M.dedupe_replies(lines_of_replies(spark, d))
    return rounded(M.usage_by_model(lines), "cost_usd", "cache_saved_usd", "cache_hit_rate")


@query(
    "usage_by_day",
    O.with_(O.COSTED, f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_SUMS}, round(sum(cache_saved_usd),6) AS saved_usd FROM costed GROUP BY 1"),
)
def usage_by_day(spark, d):
    return rounded(M.usage_by_day(B.replies(spark, d)), "cost_usd", "saved_usd")


CUT_WINDOW, CUT_BASELINE = 100_000, 400_000
CUT_SQL = f""", main AS (SELECT *, coalesce(lag(ctx) OVER s, 0) AS prev FROM costed WHERE NOT is_sidechain
  WINDOW s AS (PARTITION BY session_id ORDER BY ts, msg_id)),
cut AS (SELECT *, sum(CASE WHEN prev >= 50000 AND ctx <= prev*0.6 AND prev >= {CUT_WINDOW}*0.5 AND prev <= {CUT_WINDOW}*1.35
  THEN prev - ctx ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, msg_id) AS carry FROM main)"""


@query(
    "ctx_cut",
    O.with_(
        O.COSTED + CUT_SQL,
        f"""SELECT msg_id, ctx, CAST(carry AS BIGINT) AS carry,
  CAST(CASE WHEN carry > 0 THEN greatest(0, least(ctx + carry, {CUT_BASELINE}) - ctx) ELSE 0 END AS BIGINT) AS ctx_cut FROM cut""",
    ),
)
def ctx_cut(spark, d):
    main = M.with_cost(B.replies(spark, d)).filter(~F.col("is_sidechain"))
    return M.with_ctx_cut(main, CUT_WINDOW, CUT_BASELINE).select("msg_id", "ctx", "carry", "ctx_cut")


@query(
    "cold_cache_gaps",
    O.with_(
        O.COSTED,
        """, g AS (SELECT session_id, msg_id, (us - lag(us) OVER s)/60000000.0::DOUBLE AS gap,
  lag(ctx + output_tokens) OVER s AS t, lag(p_in) OVER s AS p, lag(cache_1h > 0) OVER s AS hour
  FROM costed WHERE NOT is_sidechain WINDOW s AS (PARTITION BY session_id ORDER BY ts, msg_id)),
c AS (SELECT *, t*p*(CASE WHEN hour THEN 2.0::DOUBLE ELSE 1.25::DOUBLE END)/1e6::DOUBLE AS cold, t*p*0.1::DOUBLE/1e6::DOUBLE AS warm FROM g)
SELECT session_id, msg_id, round(gap, 6) AS gap_minutes, round(cold, 9) AS cold_usd, round(warm, 9) AS warm_usd FROM c
WHERE gap > CASE WHEN hour THEN 60 ELSE 5 END AND cold - warm >= 0.25""",
    ),
)
def cold_cache_gaps(spark, d):
    main = M.with_cost(B.replies(spark, d)).filter(~F.col("is_sidechain"))
    out = M.cold_cache_gaps(main).select("session_id", "msg_id", "gap_minutes", "cold_usd", "warm_usd")
    return rounded(rounded(out, "gap_minutes"), "cold_usd", "warm_usd", digits=9)


def size_entries(spark, d):
    """Error events stand for user text; the others are replies."""
    df = M.with_cost(B.replies(spark, d)).withColumn("seq", F.col("msg_id"))
    is_reply = F.col("event_type") != "error"
    text = F.concat(F.lit("result "), F.repeat(F.lit("abcd "), F.col("k").cast("int")))
    return df.withColumns({"is_reply": is_reply, "text_tokens": token_estimate(text)})


SIZE_SQL = """, last AS (SELECT session_id, arg_max(ctx + output_tokens, us) AS tokens, arg_max(model, us) AS model, arg_max(p_in, us) AS p, max(us) AS last_us
  FROM costed WHERE event_type NOT IN ('error','signup') GROUP BY session_id),
pend AS (SELECT c.session_id, sum(CAST(ceil((7 + 5*c.k)/4.0) AS BIGINT)) AS pending FROM costed c JOIN last USING (session_id)
  WHERE event_type = 'error' AND c.us > last_us GROUP BY c.session_id),
hours AS (SELECT session_id, max(cache_1h) > 0 AS one_hour FROM costed GROUP BY session_id),
size AS (SELECT l.session_id, CAST(tokens + coalesce(pending, 0) AS BIGINT) AS tokens, model, p, last_us, one_hour
  FROM last l LEFT JOIN pend USING (session_id) JOIN hours USING (session_id))"""


@query("context_size", O.with_(O.COSTED + SIZE_SQL, "SELECT session_id, tokens, model, last_us, one_hour FROM size"))
def context_size(spark, d):
    return M.context_size(size_entries(spark, d))


@query(
    "session_status",
    O.with_(
        O.COSTED + SIZE_SQL,
        """, m AS (SELECT *, ((SELECT max(us) FROM ev) - last_us)/60000000.0::DOUBLE AS idle, CASE WHEN one_hour THEN 60 ELSE 5 END AS ttl,
  tokens*p*(CASE WHEN one_hour THEN 2.0::DOUBLE ELSE 1.25::DOUBLE END)/1e6::DOUBLE AS cold, tokens*p*0.1::DOUBLE/1e6::DOUBLE AS warm FROM size)
SELECT session_id, tokens, CASE WHEN tokens >= 30000 AND idle > ttl AND cold - warm >= 0.05 THEN 'cold'
  WHEN tokens >= 30000 AND idle > ttl - 1 AND idle <= ttl THEN 'expiring' WHEN tokens >= 80000*1.2 THEN 'over'
  WHEN tokens >= 80000 THEN 'growing' ELSE 'ok' END AS status, round(warm, 9) AS reply_usd, round(cold, 9) AS cold_usd FROM m""",
    ),
)
def session_status(spark, d):
    as_of = B.events(spark, d).agg(F.max("us")).scalar()
    out = M.session_status(M.context_size(size_entries(spark, d)), as_of, 100_000)
    return rounded(out, "reply_usd", "cold_usd", digits=9)


@query(
    "live_sessions",
    O.with_(
        O.REPLIES,
        """SELECT session_id, max(us) AS last_us FROM replies GROUP BY session_id
HAVING max(us) >= (SELECT max(us) FROM replies) - 90*1000000""",
    ),
)
def live_sessions(spark, d):
    replies = B.replies(spark, d)
    return M.live_sessions(replies, replies.agg(F.max("us")).scalar())


@query(
    "routing_audit",
    O.with_(
        O.REPLIES,
        """, e AS (SELECT *, event_type IN ('view','error') AS is_call,
  CASE WHEN NOT is_sidechain AND event_type NOT IN ('view','error') THEN
    CASE WHEN k % 2 = 0 THEN 'claude-opus-5-5' ELSE model END END AS main FROM replies),
f AS (SELECT *, last_value(main IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS main_model FROM e)
SELECT session_id, msg_id, main_model, 'claude-haiku-4-5' AS routed_to FROM f
WHERE event_type = 'view' AND k % 5 <> 0 AND (main_model LIKE '%opus%' OR main_model LIKE '%sonnet%')""",
    ),
)
def routing_audit(spark, d):
    kind = F.col("event_type")
    call = kind.isin("view", "error")
    df = B.replies(spark, d).withColumns(
        {
            "seq": F.col("msg_id"),
            "model": F.when(F.col("k") % 2 == 0, "claude-opus-5-5").otherwise(F.col("model")),
            "agent_type": F.when(kind == "view", "Explore").when(call, "general"),
            "agent_model": F.when(F.col("k") % 5 == 0, "opus"),
        }
    )
    out = M.routing_audit(df, "claude-haiku-4-5", ["Explore"])
    return out.select("session_id", "msg_id", "main_model", "routed_to")


_SUMMARY = """count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_read) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_creation) AS BIGINT) AS cache_write_tokens,
  round(sum(cost_usd),6) AS cost_usd, round(sum(cache_saved_usd),6) AS cache_saved_usd,
  round(sum(CASE WHEN breakpoints_added > 0 THEN cache_saved_usd ELSE 0 END),6) AS own_cache_saved_usd,
  CAST(sum(trimmed_tokens) AS BIGINT) AS trimmed_tokens, round(sum(trimmed_tokens*p_in/1e6::DOUBLE),6) AS trim_saved_usd,
  CAST(sum(ctx_cut_tokens) AS BIGINT) AS ctx_cut_tokens, round(sum(ctx_cut_tokens*p_in*0.1::DOUBLE/1e6::DOUBLE),6) AS ctx_cut_usd,
  count(*) FILTER (fallback) AS fallbacks, round(sum(cache_read)::DOUBLE/sum(ctx),6) AS cache_hit_rate"""


@query("usage_summary", O.with_(O.REQUESTS, f"SELECT {_SUMMARY} FROM requests WHERE tag IS NULL"))
def usage_summary(spark, d):
    out = M.usage_summary(B.requests(spark, d))
    return rounded(out, "cost_usd", "cache_saved_usd", "own_cache_saved_usd", "trim_saved_usd", "ctx_cut_usd", "cache_hit_rate")


@query(
    "usage_grouping_sets",
    O.with_(
        O.REQUESTS,
        f"""SELECT model, day, CAST(grouping(model, day) AS BIGINT) AS grouping, {_SUMS}, round(sum(cache_saved_usd),6) AS saved_usd
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM requests WHERE tag IS NULL) GROUP BY GROUPING SETS ((), (model), (day))""",
    ),
)
def usage_grouping_sets(spark, d):
    return rounded(M.usage_grouping_sets(B.requests(spark, d)), "cost_usd", "saved_usd")


@query(
    "meter_no_double",
    O.with_(
        O.REQUESTS,
        """SELECT session_id, count(*) AS replies FROM requests r WHERE NOT EXISTS (
  SELECT 1 FROM requests q WHERE q.tag IS NULL AND q.source = 'proxy' AND q.k = 7 AND q.us < (SELECT (min(f) + max(f)) // 2 FROM (SELECT min(us) AS f FROM requests GROUP BY session_id))
    AND q.us >= (SELECT min(us) FROM requests f WHERE f.session_id = r.session_id) - 60000000)
GROUP BY session_id""",
    ),
)
def meter_no_double(spark, d):
    log = B.requests(spark, d)
    # the proxy stopped when about half of the sessions had begun
    middle = log.groupBy("session_id").agg(F.min("us").alias("f")).agg(F.expr("(min(f) + max(f)) div 2")).scalar()
    proxy_log = log.withColumn("source", F.when((F.col("k") == 7) & (F.col("source") == "proxy") & (F.col("us") < middle), "proxy").otherwise("transcript"))
    return M.without_double_count(log, proxy_log).groupBy("session_id").agg(F.count("*").alias("replies"))


@query(
    "traffic_check",
    O.with_(
        O.REQUESTS,
        """SELECT count(DISTINCT session_id) AS sessions, count(*) FILTER (tag IS NULL AND source = 'proxy') AS requests,
  count(*) FILTER (tag IS NULL AND source = 'transcript') AS metered FROM requests
WHERE us >= (SELECT max(us) FROM ev) - 24*3600*1000000::BIGINT""",
    ),
)
def traffic_check(spark, d):
    log = B.requests(spark, d)
    return M.traffic_check(log, log.agg(F.max("us")).scalar())


_WEEK = "tag IS NULL AND ts >= (SELECT max(ts) FROM ev) - INTERVAL 7 DAYS"


@query(
    "advice_rules",
    O.with_(
        O.REQUESTS,
        f""", m AS (SELECT count(*) AS n, sum(cost_usd) AS cost, sum(CASE WHEN regexp_matches(model, 'opus|fable|mythos') THEN cost_usd ELSE 0 END) AS top,
  sum(input_tokens)::DOUBLE AS i, sum(cache_read)::DOUBLE AS r, sum(cache_creation)::DOUBLE AS w, sum(output_tokens)::DOUBLE AS o,
  count(*) FILTER (fallback) AS fb FROM requests WHERE {_WEEK}),
f AS (SELECT arg_min(ctx, us) AS c FROM costed WHERE NOT is_sidechain AND ctx >= 1000 GROUP BY session_id),
b AS (SELECT list_sort(list(c))[count(*)//2 + 1]::DOUBLE AS base FROM f)
SELECT rule, round(value, 6) AS value FROM (
  SELECT 'low-hit-rate' AS rule, r/(i+r+w) AS value FROM m WHERE n >= 20 AND r/(i+r+w) < 0.5
  UNION ALL SELECT 'top-tier-share', top/cost FROM m WHERE top/cost > 0.6
  UNION ALL SELECT 'big-context', (i+r+w)/n FROM m WHERE n >= 20 AND (i+r+w)/n > 150000
  UNION ALL SELECT 'big-baseline', base FROM m, b WHERE n >= 20 AND base > 30000
  UNION ALL SELECT 'long-output', o/greatest(1, i+o) FROM m WHERE o/greatest(1, i+o) > 0.35
  UNION ALL SELECT 'fallbacks', fb::DOUBLE FROM m WHERE fb > 0)""",
    ),
)
def advice_rules(spark, d):
    from tracewell.operators.context import baseline_overhead

    log = B.requests(spark, d)
    base = baseline_overhead(M.with_cost(log).withColumn("seq", F.col("us"))).select("median_tokens").scalar()
    return rounded(M.advice_rules(log, log.agg(F.max("ts")).scalar(), base), "value")


@query(
    "spend_calendar",
    O.with_(
        O.REQUESTS,
        f""", cal AS (SELECT strftime((SELECT max(ts) FROM ev)::DATE - CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(14) t(i)),
daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(cost_usd) AS c, sum(cache_saved_usd) AS s FROM requests WHERE tag IS NULL GROUP BY 1)
SELECT day, coalesce(n, 0) AS requests, round(coalesce(c, 0), 6) AS cost_usd, round(coalesce(s, 0), 6) AS saved_usd,
  round((SELECT sum(cost_usd)/7*30 FROM requests WHERE {_WEEK}), 6) AS month_usd FROM cal LEFT JOIN daily USING (day)""",
    ),
)
def spend_calendar(spark, d):
    log = B.requests(spark, d)
    out = M.spend_calendar(log, log.agg(F.max("ts")).scalar())
    return rounded(out, "cost_usd", "saved_usd", "month_usd")


@query(
    "savings_report",
    O.with_(
        O.REQUESTS + ", " + O.ACTIVITY_ONLY,
        """, top AS (SELECT arg_max(p_in, c) AS p FROM (SELECT model, any_value(p_in) AS p_in, sum(cost_usd) AS c FROM requests WHERE tag IS NULL GROUP BY model)),
t AS (SELECT sum(cost_usd) AS spend, sum(trimmed_tokens) AS trimmed, sum(ctx_cut_tokens) AS cut, sum(ctx_cut_tokens*p_in*0.1::DOUBLE/1e6::DOUBLE) AS cut_usd,
  sum(CASE WHEN breakpoints_added > 0 THEN cache_saved_usd ELSE 0 END) AS own FROM requests WHERE tag IS NULL),
kinds AS (SELECT kind, count(*) AS n, sum(tokens) AS tok FROM activity GROUP BY kind),
grp(kind, part) AS (VALUES ('trim','trim'),('dedupe','trim'),('cmdrules','cmdrules'),('testsum','testsum'),('json','json'),
  ('read-guard','reads'),('reread','reads'),('outline','reads'),('media','media'),('handoff','handoff')),
g AS (SELECT part, sum(greatest(tok, 0)) + CASE WHEN part = 'trim' THEN (SELECT trimmed FROM t) ELSE 0 END AS tok, sum(n) AS n FROM kinds JOIN grp USING (kind) GROUP BY part),
parts AS (SELECT part, 'measured' AS tier, CASE WHEN part = 'handoff' THEN 0 ELSE tok END AS tokens, n,
    CASE WHEN part = 'handoff' THEN 0.0::DOUBLE ELSE tok*(SELECT p FROM top)/1e6::DOUBLE END AS usd FROM g
  UNION ALL SELECT 'context', 'derived', cut, 0, cut_usd FROM t UNION ALL SELECT 'cache', 'estimate', 0, 0, own FROM t),
shown AS (SELECT * FROM parts WHERE usd > 0 OR n > 0),
c AS (SELECT (SELECT sum(greatest(-tok, 0)) FROM kinds)*(SELECT p FROM top)/1e6::DOUBLE AS cost),
h AS (SELECT sum(usd) AS saved, sum(usd) FILTER (tier = 'measured') AS measured FROM shown),
n AS (SELECT saved, spend, cost, greatest(0, saved - cost) AS net, greatest(0, measured - cost) AS mnet FROM h, t, c)
SELECT part, tier, CAST(tokens AS BIGINT) AS tokens, CAST(n AS BIGINT) AS n, round(usd, 6) AS usd, NULL AS spend_usd, NULL AS cost_usd, NULL AS net_usd,
  NULL AS pct, NULL AS measured_net_usd, NULL AS measured_pct FROM shown
UNION ALL SELECT 'total', 'all', 0, 0, round(saved, 6), round(spend, 6), round(cost, 6), round(net, 6), round(net/(spend + net), 6),
  round(mnet, 6), round(mnet/(spend + mnet), 6) FROM n""",
    ),
)
def savings_report(spark, d):
    out = M.savings_report(B.requests(spark, d), B.activity(spark, d))
    return rounded(out, "usd", "spend_usd", "cost_usd", "net_usd", "pct", "measured_net_usd", "measured_pct")


@query("activity_by_kind", O.with_(O.ACTIVITY, "SELECT kind, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM activity GROUP BY kind"))
def activity_by_kind(spark, d):
    return M.activity_by_kind(B.activity(spark, d))


@query("activity_tail", O.with_(O.ACTIVITY, "SELECT event_id, kind, tokens, msg FROM activity ORDER BY ts DESC, event_id DESC LIMIT 500"))
def activity_tail(spark, d):
    return M.activity_tail(B.activity(spark, d), 500).select("event_id", "kind", "tokens", "msg")


@query(
    "cache_miss_by_cause",
    O.with_(
        O.ACTIVITY,
        """SELECT regexp_extract(msg, '\\(([a-zA-Z0-9_-]+)\\)', 1) AS cause, count(*) AS n, CAST(sum(-tokens) AS BIGINT) AS tokens,
  (list(msg ORDER BY tokens, event_id))[1] AS example FROM activity WHERE kind = 'cache-miss' GROUP BY 1""",
    ),
)
def cache_miss_by_cause(spark, d):
    return M.cache_miss_by_cause(B.activity(spark, d))
