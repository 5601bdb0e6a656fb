"""Usage metering: dedupe, cost, context cuts and spend reports.

Inputs follow the request schema: session_id, msg_id, ts, us (epoch micros),
model, input_tokens, cache_read, cache_creation, cache_1h, output_tokens,
is_sidechain and, for the request log, tag, source, breakpoints_added,
trimmed_tokens, ctx_cut_tokens, fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import rules as R
from tracewell.functions import pricing as P
from tracewell.functions.ordered import day_bucket, lag, last_value, running_sum, with_carried

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


def dedupe_replies(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (session, message id); the last line of a reply wins.

    Grouping instead of a window keeps a map-side combine, so a hot session
    still spreads over its message ids.
    """
    keys = ["session_id", "msg_id"]
    rest = [c for c in lines.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(seq)).alias("r")
    return lines.groupBy(*keys).agg(last).select(*keys, *[f"r.{c}" for c in rest])


def with_cost(df: DataFrame, prices=R.PRICES) -> DataFrame:
    """Add cost_usd, cache_saved_usd and ctx (tokens the reply read)."""
    m = F.col("model")
    cols = [F.col(c) for c in ("input_tokens", "cache_read", "cache_creation", "cache_1h", "output_tokens")]
    return df.withColumns(
        {
            "price_in": P.input_price(m, prices),
            "cost_usd": P.request_cost(m, *cols, prices=prices),
            "cache_saved_usd": P.cache_savings(m, F.col("cache_read"), prices),
            "ctx": P.zero(F.col("input_tokens")) + P.zero(F.col("cache_read")) + P.zero(F.col("cache_creation")),
        }
    )


def with_ctx_cut(df: DataFrame, window: int, baseline: int, bucket: Column | None = None) -> DataFrame:
    """Tokens each main reply did not re-read because an earlier compaction shrank the chat.

    A drop counts when it starts near the window; the running total of drops is
    carried on and credited up to the usual chat size ``baseline``.
    """
    bucket = day_bucket() if bucket is None else bucket
    key, order = ["session_id"], ["ts", "msg_id"]
    df = with_carried(df, key, order, [lag("prev_ctx", F.col("ctx"))], bucket)
    prev, ctx = F.coalesce("prev_ctx", F.lit(0)), F.col("ctx")
    compacted = (
        (F.lit(window) > 0)
        & (prev >= R.CUT_MIN_PREVIOUS)
        & (ctx <= prev * R.CUT_MAX_RATIO)
        & prev.between(window * R.CUT_WINDOW_LOW, window * R.CUT_WINDOW_HIGH)
    )
    drop = F.when(compacted, prev - ctx).otherwise(0).cast("bigint")
    df = with_carried(df.withColumn("drop", drop), key, order, [running_sum("carry", F.col("drop"))], bucket)
    credit = F.greatest(F.lit(0), F.least(ctx + F.col("carry"), F.lit(baseline)) - ctx).cast("bigint")
    return df.withColumn("ctx_cut", F.when((F.col("carry") > 0) & (F.lit(baseline) > 0), credit).otherwise(0).cast("bigint"))


def without_double_count(batch: DataFrame, log: DataFrame, slack_seconds: int = 60) -> DataFrame:
    """Drop a session's transcript batch when the proxy already logged calls in its time range.

    Only the newest untagged proxy request matters, so the log reduces to one
    scalar and no range join is needed.
    """
    proxied = log.filter(F.col("tag").isNull() & (F.col("source") != "transcript"))
    newest = proxied.agg(F.max("us")).scalar()
    first = batch.groupBy("session_id").agg(F.min("us").alias("first_us"))
    kept = first.filter(F.coalesce(newest < F.col("first_us") - slack_seconds * 1_000_000, F.lit(True)))
    return batch.join(kept.select("session_id"), "session_id", "left_semi")


def _measures() -> list[Column]:
    trimmed_usd = F.col("trimmed_tokens") * F.col("price_in") / 1e6
    cut_usd = F.col("ctx_cut_tokens") * F.col("price_in") * R.CACHE_READ_MULT / 1e6
    return [
        F.count("*").alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read").alias("cache_read_tokens"),
        F.sum("cache_creation").alias("cache_write_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("cache_saved_usd").alias("cache_saved_usd"),
        F.sum(F.when(F.col("breakpoints_added") > 0, F.col("cache_saved_usd")).otherwise(0.0)).alias("own_cache_saved_usd"),
        F.sum("trimmed_tokens").alias("trimmed_tokens"),
        F.sum(trimmed_usd).alias("trim_saved_usd"),
        F.sum("ctx_cut_tokens").alias("ctx_cut_tokens"),
        F.sum(cut_usd).alias("ctx_cut_usd"),
        F.count_if("fallback").alias("fallbacks"),
    ]


def hit_rate(read: Column, inp: Column, write: Column) -> Column:
    return F.coalesce(F.try_divide(read, inp + read + write), F.lit(0.0))


def usage_summary(requests: DataFrame, since: Column | None = None) -> DataFrame:
    """Totals over untagged requests, one hash aggregate."""
    df = with_cost(requests).filter(F.col("tag").isNull())
    if since is not None:
        df = df.filter(F.col("ts") >= since)
    out = df.agg(*_measures())
    rate = hit_rate(F.col("cache_read_tokens"), F.col("input_tokens"), F.col("cache_write_tokens"))
    return out.withColumn("cache_hit_rate", rate)


def usage_by_model(df: DataFrame) -> DataFrame:
    out = with_cost(df).groupBy("model").agg(
        F.count("*").alias("requests"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("cache_saved_usd").alias("cache_saved_usd"),
        F.sum("input_tokens").alias("_i"),
        F.sum("cache_read").alias("_r"),
        F.sum("cache_creation").alias("_w"),
    )
    return out.withColumn("cache_hit_rate", hit_rate(F.col("_r"), F.col("_i"), F.col("_w"))).drop("_i", "_r", "_w")


def usage_by_day(df: DataFrame) -> DataFrame:
    return (
        with_cost(df)
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count("*").alias("requests"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("cache_saved_usd").alias("saved_usd"),
        )
    )


def usage_grouping_sets(requests: DataFrame) -> DataFrame:
    """Totals, by model and by day from one scan."""
    df = with_cost(requests).filter(F.col("tag").isNull()).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return df.groupingSets([[], ["model"], ["day"]], "model", "day").agg(
        F.grouping_id().cast("bigint").alias("grouping"),
        F.count("*").alias("requests"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("cache_saved_usd").alias("saved_usd"),
    )


def usage_rollup(requests: DataFrame, *by: str) -> DataFrame:
    """Spend subtotals along ``by`` (for example project, model)."""
    return with_cost(requests).rollup(*by).agg(F.count("*").alias("requests"), F.sum("cost_usd").alias("cost_usd"))


def usage_cube(requests: DataFrame, *by: str) -> DataFrame:
    """Spend for every combination of ``by`` (for example project, day)."""
    return with_cost(requests).cube(*by).agg(F.count("*").alias("requests"), F.sum("cost_usd").alias("cost_usd"))


def activity_by_kind(activity: DataFrame) -> DataFrame:
    return activity.groupBy("kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def activity_tail(activity: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows (a per-partition top-n, then a merge)."""
    return activity.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def savings_report(requests: DataFrame, activity: DataFrame) -> DataFrame:
    """Saved, spent and net dollars, one row per part plus a total row.

    Token groups count only positive sums and are priced at the input price of
    the model with the highest spend; every negative kind is a cost.
    """
    total = usage_summary(requests)
    top = usage_by_model(requests.filter(F.col("tag").isNull())).agg(F.max_by("model", F.struct("cost_usd", "model")).alias("m"))
    price = P.input_price(F.coalesce(top.scalar(), F.lit(R.DEFAULT_MODEL))) / 1e6
    kinds = activity_by_kind(activity)
    group = F.when(F.lit(False), "")
    for key, names in R.SAVING_GROUPS:
        group = group.when(F.col("kind").isin(names), key)
    kinds = kinds.withColumns({"part": group, "saved": F.greatest("tokens", F.lit(0)), "spent": F.greatest(-F.col("tokens"), F.lit(0))})
    spent = kinds.agg(F.coalesce(F.sum("spent"), F.lit(0))).scalar()
    parts = kinds.filter("part is not null").groupBy("part").agg(F.sum("saved").alias("tokens"), F.sum("n").alias("n"))
    trimmed = total.select("trimmed_tokens").scalar()
    parts = parts.withColumn("tokens", F.col("tokens") + F.when(F.col("part") == "trim", trimmed).otherwise(0))
    unpriced = F.col("part").isin(R.UNPRICED_GROUPS)
    parts = parts.select(
        "part",
        F.lit("measured").alias("tier"),
        F.when(unpriced, 0).otherwise(F.col("tokens")).cast("bigint").alias("tokens"),
        "n",
        F.when(unpriced, 0.0).otherwise(F.col("tokens") * price).alias("usd"),
    )
    zero = F.lit(0).cast("bigint")
    derived = total.select(F.lit("context").alias("part"), F.lit("derived").alias("tier"), F.col("ctx_cut_tokens").alias("tokens"), zero.alias("n"), F.col("ctx_cut_usd").alias("usd"))
    cache = total.select(F.lit("cache").alias("part"), F.lit("estimate").alias("tier"), zero.alias("tokens"), zero.alias("n"), F.col("own_cache_saved_usd").alias("usd"))
    parts = parts.unionByName(derived).unionByName(cache).filter((F.col("usd") > 0) | (F.col("n") > 0))
    spend, cost = total.select("cost_usd").scalar(), spent * price
    sums = parts.agg(F.sum("usd").alias("saved"), F.sum(F.when(F.col("tier") == "measured", F.col("usd"))).alias("measured"))
    net, mnet = F.greatest(F.lit(0.0), F.col("saved") - cost), F.greatest(F.lit(0.0), F.coalesce("measured", F.lit(0.0)) - cost)
    head = sums.select(
        F.lit("total").alias("part"), F.lit("all").alias("tier"), zero.alias("tokens"), zero.alias("n"),
        F.col("saved").alias("usd"), spend.alias("spend_usd"), cost.alias("cost_usd"), net.alias("net_usd"),
        F.coalesce(F.try_divide(net, spend + net), F.lit(0.0)).alias("pct"),
        mnet.alias("measured_net_usd"),
        F.coalesce(F.try_divide(mnet, spend + mnet), F.lit(0.0)).alias("measured_pct"),
    )
    return parts.unionByName(head, allowMissingColumns=True)


def traffic_check(requests: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Sessions seen against proxied and metered requests in the last hours."""
    recent = requests.filter(F.col("us") >= as_of - hours * 3_600_000_000)
    own = F.col("tag").isNull()
    metered = F.col("source") == "transcript"
    return recent.agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(own & ~metered).alias("requests"),
        F.count_if(own & metered).alias("metered"),
    )


def spend_calendar(requests: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Zero-filled daily series ending at ``as_of`` plus the month the last week projects to."""
    spark = requests.sparkSession
    last = F.to_date(as_of)
    daily = usage_by_day(requests.filter(F.col("tag").isNull()))
    week = with_cost(requests.filter(F.col("tag").isNull())).filter(F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS"))
    monthly = week.agg(F.sum("cost_usd") / 7 * 30).scalar()
    calendar = spark.range(days).select(F.date_format(F.date_sub(last, F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    return calendar.join(daily, "day", "left").select(
        "day",
        F.coalesce("requests", F.lit(0)).cast("bigint").alias("requests"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("saved_usd", F.lit(0.0)).alias("saved_usd"),
        monthly.alias("month_usd"),
    )


def advice_rules(requests: DataFrame, as_of: Column, baseline_tokens: Column | None = None) -> DataFrame:
    """Advice that fires on last week's numbers: (rule, value) rows."""
    week = with_cost(requests).filter(F.col("tag").isNull() & (F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")))
    top = F.col("model").rlike("opus|fable|mythos")
    m = week.agg(
        F.count("*").alias("n"),
        F.sum("cost_usd").alias("cost"),
        F.sum(F.when(top, F.col("cost_usd")).otherwise(0.0)).alias("top_cost"),
        F.sum("input_tokens").alias("i"),
        F.sum("cache_read").alias("r"),
        F.sum("cache_creation").alias("w"),
        F.sum("output_tokens").alias("o"),
        F.count_if("fallback").alias("fb"),
    )
    base = F.lit(None).cast("double") if baseline_tokens is None else baseline_tokens.cast("double")
    enough = F.col("n") >= 20
    rate = hit_rate(F.col("r"), F.col("i"), F.col("w"))
    share = F.coalesce(F.try_divide(F.col("top_cost"), F.col("cost")), F.lit(0.0))
    avg_ctx = F.coalesce(F.try_divide(F.col("i") + F.col("r") + F.col("w"), F.col("n")), F.lit(0.0))
    out_share = F.col("o") / F.greatest(F.lit(1), F.col("i") + F.col("o"))
    rows = [
        ("low-hit-rate", rate, enough & (rate < 0.5)),
        ("top-tier-share", share, share > 0.6),
        ("big-context", avg_ctx, enough & (avg_ctx > 150_000)),
        ("big-baseline", base, enough & (base > 30_000)),
        ("long-output", out_share, out_share > 0.35),
        ("fallbacks", F.col("fb").cast("double"), F.col("fb") > 0),
    ]
    packed = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("value"), f.alias("fires")) for k, v, f in rows])
    return m.select(F.inline(packed)).filter("fires").select("rule", "value")


def cold_cache_gaps(replies: DataFrame, min_extra_usd: float = R.IDLE_MIN_EXTRA_USD, bucket: Column | None = None) -> DataFrame:
    """Replies that follow a gap longer than the cache lifetime, with the cold and warm price of the context."""
    before = F.struct(F.col("us").alias("us"), (F.col("ctx") + F.col("output_tokens")).alias("ctx"), F.col("model").alias("model"), (F.col("cache_1h") > 0).alias("hour"))
    df = with_carried(replies, ["session_id"], ["ts", "msg_id"], [lag("before", before)], day_bucket() if bucket is None else bucket)
    hour = F.col("before.hour")
    ttl = F.when(hour, R.TTL_LONG_MINUTES).otherwise(R.TTL_SHORT_MINUTES)
    cold = P.cold_cost(F.col("before.ctx"), F.col("before.model"), hour)
    warm = P.warm_cost(F.col("before.ctx"), F.col("before.model"))
    df = df.withColumns({"gap_minutes": (F.col("us") - F.col("before.us")) / MINUTE_US, "cold_usd": cold, "warm_usd": warm})
    return df.filter((F.col("gap_minutes") > ttl) & (F.col("cold_usd") - F.col("warm_usd") >= min_extra_usd)).drop("before")


def context_size(entries: DataFrame) -> DataFrame:
    """Latest context per session: last main reply's four counters plus user text added since.

    ``entries`` has us, seq, is_reply, is_sidechain, the counters and text_tokens (user rows).
    """
    at = F.struct("us", "seq")
    main = ~F.col("is_sidechain")
    reply = F.col("is_reply") & main
    filled = F.col("ctx") + F.col("output_tokens")
    last = entries.groupBy("session_id").agg(
        F.max_by(F.struct(filled.alias("tokens"), "model", "us", "seq"), F.when(reply, at)).alias("last"),
        F.max(F.when(F.col("is_reply"), F.col("cache_1h")).otherwise(0)).alias("max_1h"),
    )
    texts = entries.filter(~F.col("is_reply") & main).select("session_id", "us", "seq", "text_tokens")
    later = (
        texts.join(last.select("session_id", F.col("last.us").alias("l_us"), F.col("last.seq").alias("l_seq")), "session_id")
        .filter(F.col("l_us").isNull() | (F.struct("us", "seq") > F.struct("l_us", "l_seq")))
        .groupBy("session_id")
        .agg(F.sum("text_tokens").alias("pending"))
    )
    zero = F.lit(0).cast("bigint")
    return last.join(later, "session_id", "left").select(
        "session_id",
        (F.coalesce("last.tokens", zero) + F.coalesce("pending", zero)).alias("tokens"),
        F.coalesce("last.model", F.lit("")).alias("model"),
        F.col("last.us").alias("last_us"),
        (F.col("max_1h") > 0).alias("one_hour"),
    )


def session_status(sizes: DataFrame, as_of_us: Column, window_tokens: int, first_tokens: int = 150_000) -> DataFrame:
    """cold / expiring / over-limit / growing / ok per session, first match wins."""
    idle = (as_of_us - F.col("last_us")) / MINUTE_US
    ttl = F.when(F.col("one_hour"), R.TTL_LONG_MINUTES).otherwise(R.TTL_SHORT_MINUTES)
    limit = window_tokens * 0.8 if window_tokens > 0 else float(first_tokens)
    cold = P.cold_cost(F.col("tokens"), F.col("model"), F.col("one_hour"))
    warm = P.warm_cost(F.col("tokens"), F.col("model"))
    big = F.col("tokens") >= 30_000
    status = (
        F.when(big & (idle > ttl) & (cold - warm >= 0.05), "cold")
        .when(big & (idle > ttl - 1) & (idle <= ttl), "expiring")
        .when(F.col("tokens") >= limit * 1.2, "over")
        .when(F.col("tokens") >= limit, "growing")
        .otherwise("ok")
    )
    return sizes.select("session_id", "tokens", status.alias("status"), warm.alias("reply_usd"), cold.alias("cold_usd"))


def live_sessions(heartbeats: DataFrame, as_of_us: Column, seconds: int = 90) -> DataFrame:
    last = heartbeats.groupBy("session_id").agg(F.max("us").alias("last_us"))
    return last.filter(F.col("last_us") >= as_of_us - seconds * 1_000_000)


def cache_miss_by_cause(activity: DataFrame) -> DataFrame:
    """Cache misses per cause with tokens and the example that cost most."""
    cause = F.regexp_extract("msg", r"\(([a-zA-Z0-9_-]+)\)", 1)
    miss = activity.filter(F.col("kind") == "cache-miss").withColumn("cause", F.when(cause == "", "unknown").otherwise(cause))
    return miss.groupBy("cause").agg(
        F.count("*").alias("n"),
        F.sum(-F.col("tokens")).alias("tokens"),
        F.max_by("msg", F.struct(-F.col("tokens"), -F.col("event_id"))).alias("example"),
    )


TIER = {"haiku": 1, "sonnet": 2, "opus": 3}


def tier_rank(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("opus"), 3).when(m.contains("sonnet"), 2).when(m.contains("haiku"), 1)


def routing_audit(entries: DataFrame, light_model: str, light_agents: list[str], bucket: Column | None = None) -> DataFrame:
    """Subagent calls that could run on ``light_model``: read-only type, no model given, main chat on a higher tier.

    ``entries`` holds main replies (model set) and agent calls (agent_type set) in order.
    """
    seen = last_value("main_model", F.when(F.col("agent_type").isNull() & ~F.col("is_sidechain"), F.col("model")), True)
    df = with_carried(entries, ["session_id"], ["ts", "seq"], [seen], day_bucket() if bucket is None else bucket)
    target = max((rank for name, rank in TIER.items() if name in light_model), default=0)
    return df.filter(
        F.col("agent_type").isin(light_agents) & F.col("agent_model").isNull() & (tier_rank(F.col("main_model")) > target) & F.lit(target > 0)
    ).withColumn("routed_to", F.lit(light_model))

