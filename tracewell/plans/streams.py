"""Streaming jobs over the event files; the check SQL holds the windows that the watermark has passed."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import pricing as P
from tracewell.operators import metering
from tracewell.plans import behaviour
from tracewell.plans import facts as fact_plans
from tracewell.plans import oracle as O
from tracewell.plans.registry import ORACLES, query, table
from tracewell.plans.transcripts import LAYOUT, quoted, written_lines
from tracewell.session import work_path
from tracewell.sources import bindings as B
from tracewell.streaming import facts, jobs, stateful

DONE = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def stream(spark, d):
    """events.parquet as a stream; times are UTC."""
    schema = table(spark, d, "events").schema
    return jobs.arriving(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def written(out, name):
    """The sink's rows with times as the event files hold them."""
    got = jobs.run_available(out, name)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in got.dtypes if kind == "timestamp"})


@query("stream_tumbling", f"SELECT * FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE window_end <= {DONE}")
def stream_tumbling(spark, d):
    return written(jobs.windowed(stream(spark, d), "ts", F.window("ts", "1 minute"), ["event_type"], F.count("*").alias("n")), "tumbling")


@query(
    "stream_sliding",
    f"""WITH s AS (SELECT *, date_trunc('day', ts) - to_days(i::INT) AS window_start FROM events, range(7) t(i))
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM s WHERE window_start + INTERVAL 7 DAY <= {DONE} GROUP BY ALL""",
)
def stream_sliding(spark, d):
    out = jobs.windowed(stream(spark, d), "ts", F.window("ts", "7 days", "1 day"), ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return written(out, "sliding")


@query(
    "stream_session",
    f"""WITH g AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 60 MINUTE AS cut FROM events),
r AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
SELECT * FROM (SELECT min(ts) AS window_start, max(ts) + INTERVAL 60 MINUTE AS window_end, user_id, count(*) AS n FROM r GROUP BY user_id, no) WHERE window_end <= {DONE}""",
)
def stream_session(spark, d):
    return written(jobs.windowed(stream(spark, d), "ts", F.session_window("ts", "60 minutes"), ["user_id"], F.count("*").alias("n")), "session")


# every event arrives twice
@query("stream_dedupe", "SELECT event_id, user_id, ts FROM events")
def stream_dedupe(spark, d):
    twice = stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return written(jobs.first_arrivals(twice, "ts", ["event_id"]).select("event_id", "user_id", "ts"), "dedupe")


# --- jobs that are started again: the input lands in three parts, and the job runs after each ---

PARTS = 3
#: Approximate percentiles are right to one row in so many.
ACCURACY = 10_000


def at_shares(df, order, shares):
    """The exact values of ``order`` that have these shares of its rows before them, without any list of all values:
    only those near each place, as approximate percentiles find them, are counted one by one."""
    c = F.col(order)
    margins = [min(max(s + e / ACCURACY, 0.0), 1.0) for s in shares for e in (-4, 4)]
    n, least, most, near = df.agg(F.count(c), F.min(c), F.max(c), F.percentile_approx(c, margins, ACCURACY)).first()
    out = []
    for i, share in enumerate(shares if n else []):
        low, high = (near[2 * i], near[2 * i + 1]) if n > ACCURACY else (least, most)
        here = df.where(c <= high).groupBy(F.greatest(c, F.lit(low)).alias("v")).count()
        upto = F.sum("count").over(W.orderBy("v"))
        out.append(here.withColumn("upto", upto).where(F.col("upto") > int(share * (n - 1))).agg(F.min("v")).first()[0])
    return out


def landed(spark, df, order):
    """(folder, [write]): calling a write lands the next third of ``df`` in ``order``, a file per task."""
    folder = work_path(spark, "landing")
    part = F.lit(0)
    for b in at_shares(df, order, [i / PARTS for i in range(1, PARTS)]):
        part = part + (F.col(order) > b).cast("int")
    df = df.withColumn("__part", part)
    return folder, [lambda i=i: df.where(F.col("__part") == i).drop("__part").write.mode("append").parquet(folder) for i in range(PARTS)]


def in_runs(spark, df, order, name, transform):
    """Runs ``transform`` of the stream over the three parts, each run going on from the checkpoint of the last."""
    folder, writes = landed(spark, df, order)
    checkpoint, sink = work_path(spark, f"{name}-state"), work_path(spark, f"{name}-sink")
    for write in writes:
        write()
        with stateful.keyed_state(spark):
            out = transform(jobs.arriving(spark, folder, df.schema))
            got = jobs.run_available(out, name, checkpoint, sink)
    return got


@query("stream_alerts", ORACLES["alert_levels"])
def stream_alerts(spark, d):
    events = behaviour.level_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    got = in_runs(spark, events, "us", "alerts", lambda s: stateful.alert_levels(s, 50_000))
    return got.select(F.col("seq").alias("msg_id"), "session_id", "level", "items", "total")


@query("stream_cache_watch", f"SELECT msg_id, culprit FROM ({ORACLES['cache_miss_diag']})")
def stream_cache_watch(spark, d):
    got = in_runs(spark, behaviour.prefixes(spark, d), "us", "watch", stateful.cache_watch)
    return got.select(F.col("seq").alias("msg_id"), "culprit")


@query(
    "stream_ingest",
    O.with_(O.REPLIES, "SELECT 'u' || session_id % 50 AS session_id, 'm' || msg_id AS msg_id, model, input_tokens, output_tokens, CASE WHEN msg_id % 7 = 0 THEN 2 ELSE 1 END AS n_lines FROM replies"),
)
def stream_ingest(spark, d):
    """A line per reply, a second one in a later part for every seventh; the job runs after each of three parts."""
    replies = B.replies(spark, d)
    usage = F.concat(F.lit('{"input_tokens":'), "input_tokens", F.lit(',"output_tokens":'), "output_tokens", F.lit("}"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.concat(F.lit('{"type":"assistant","timestamp":"'), at, F.lit('","message":{"id":"m'), "msg_id", F.lit('","model":'), quoted("model"), F.lit(',"content":[],"usage":'), usage, F.lit("}}"))
    copies = F.when(F.col("msg_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lines = replies.select(F.concat(F.lit("u"), F.col("session_id") % 50).alias("session"), F.lit(0).alias("sub"), line.alias("value"), "msg_id", F.explode(copies).alias("copy"))
    landing, checkpoint, sink = (work_path(spark, x) for x in ("landing", "ingest-state", "ingest-sink"))
    for part in range(PARTS):
        written_lines(lines.where((F.col("msg_id") + F.col("copy")) % PARTS == part).select("session", "sub", "value"), landing)
        entries = jobs.ingest_transcripts(spark, landing, checkpoint, sink, **LAYOUT)
    n_lines = entries.groupBy("session_id", "msg_id").agg(F.count("*").cast("int").alias("n_lines"))
    replies = metering.dedupe_replies(entries.select("session_id", "msg_id", "model", "input_tokens", "output_tokens", F.col("ts").alias("seq"))).drop("seq")
    return replies.join(n_lines, ["session_id", "msg_id"])


@query("stream_enrich", O.with_(O.COSTED, "SELECT msg_id, model, p_in, p_out, round(cost_usd, 9) AS cost_usd FROM costed"))
def stream_enrich(spark, d):
    """Prices of a catalog that lacks some models; those take the ordered rules by prefix."""
    replies = B.replies(spark, d)
    folder = work_path(spark, "landing")
    replies.write.parquet(folder)
    model = F.col("model")
    known = replies.select("model").distinct().where("model <> 'gpt-5-mini'").select("model", P.input_price(model).alias("p_in"), P.output_price(model).alias("p_out"))
    out = jobs.enriched(jobs.arriving(spark, folder, replies.schema), known, "model", {"p_in": P.input_price(model), "p_out": P.output_price(model)})
    mult = P.cache_write_mult(F.col("cache_creation"), F.col("cache_1h"))
    cost = (F.col("input_tokens") * F.col("p_in") + F.col("cache_read") * F.col("p_in") * 0.1 + F.col("cache_creation") * F.col("p_in") * mult + F.col("output_tokens") * F.col("p_out")) / 1e6
    return jobs.run_available(out.select("msg_id", "model", "p_in", "p_out", F.round(cost, 9).alias("cost_usd")), "enrich")


# events arrive by their number and not by their time, so that many are late
@query(
    "stream_late",
    """WITH p AS (SELECT *, (event_id > (SELECT quantile_cont(event_id, 1/3.0) FROM events))::INT + (event_id > (SELECT quantile_cont(event_id, 2/3.0) FROM events))::INT AS part FROM events),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM p GROUP BY part)
SELECT event_id, ts, coalesce(ts < mark, false) AS late FROM p JOIN m USING (part)""",
)
def stream_late(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, writes = landed(spark, events, "event_id")
    checkpoint, sink = work_path(spark, "late-state"), work_path(spark, "late-sink")
    for write in writes:
        write()
        on_time, late = jobs.split_late(jobs.arriving(spark, folder, events.schema), "ts", checkpoint, sink)
    rows = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "late")


@query("stream_facts")
def stream_facts(spark, d):
    """Facts of conversations whose blocks land in three parts by turn; a session is searched after each 200 characters."""
    blocks = fact_plans.blocks(spark, d)
    folder, writes = landed(spark, blocks, "seq")
    checkpoint, sink = work_path(spark, "facts-state"), work_path(spark, "facts-sink")
    for write in writes:
        write()
        out = facts.capture_facts(jobs.arriving(spark, folder, blocks.schema), checkpoint, sink, fact_plans.RULES, 200, bucket=F.floor(F.col("seq") / 2))
    return out
