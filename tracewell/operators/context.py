"""How context grows between compactions, and what fills it.

``chain`` rows: session_id, project, ts, us, seq, msg_id, is_boundary, ctx,
cache_creation, cache_1h, model, summary_chars (main chain only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell import rules as R
from tracewell.functions import pricing as P
from tracewell.functions.ordered import day_bucket, lag, last_value, running_sum, with_carried

KEY, ORDER = ["session_id"], ["ts", "seq"]


def sawtooth(chain: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Segments between compaction boundaries with growth per reply and the segment's start sample."""
    bucket = day_bucket() if bucket is None else bucket
    chain = chain.filter(F.col("is_boundary") | (F.col("ctx") > 0))
    reply_id = F.when(~F.col("is_boundary"), F.col("msg_id"))
    df = with_carried(chain, KEY, ORDER, [last_value("last_id", reply_id)], bucket)
    df = df.filter(F.col("is_boundary") | F.col("last_id").isNull() | (F.col("last_id") != F.col("msg_id"))).drop("last_id")
    boundary = F.col("is_boundary").cast("bigint")
    prev = F.struct("is_boundary", "ctx")
    df = with_carried(df, KEY, ORDER, [running_sum("segment", boundary), lag("prev", prev)], bucket)
    reply, after = ~F.col("is_boundary"), F.col("prev.is_boundary")
    step = reply & F.col("prev").isNotNull() & ~after
    return df.withColumns(
        {
            "is_start": reply & (F.col("prev").isNull() | after),
            "is_step": F.coalesce(step, F.lit(False)),
            "is_post": reply & F.coalesce(after, F.lit(False)),
            "growth": F.when(step, F.greatest(F.lit(0), F.col("ctx") - F.col("prev.ctx"))).otherwise(0).cast("bigint"),
        }
    ).drop("prev")


def start_floor(saw: DataFrame, notices: DataFrame, since_us: Column) -> DataFrame:
    """Per project: nearest-rank p90 of start contexts, sample count, thrash stops, full-schema requests.

    ``notices`` rows (project, us, kind in thrash/full) mark compaction loops and
    requests that carried every tool schema.
    """
    floors = (
        saw.filter(F.col("is_start") & (F.col("us") > since_us))
        .groupBy("project")
        .agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY ctx)").cast("bigint").alias("floor"), F.count("*").alias("samples"))
    )
    marks = (
        notices.filter(F.col("us") > since_us)
        .groupBy("project")
        .agg(F.count_if(F.col("kind") == "thrash").alias("thrash"), F.count_if(F.col("kind") == "full").alias("full"))
    )
    zero = F.lit(0).cast("bigint")
    return floors.join(marks, "project", "left").select(
        "project", "floor", "samples", F.coalesce("thrash", zero).alias("thrash"), F.coalesce("full", zero).alias("full_requests")
    )


def growth_daily(saw: DataFrame) -> DataFrame:
    """Nine sums per project and day that feed the window model."""
    reply = ~F.col("is_boundary")
    pick = lambda cond, c: F.sum(F.when(cond, c).otherwise(0)).cast("bigint")
    return saw.groupBy("project", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(reply).alias("replies"),
        F.count_if("is_step").alias("growth_steps"),
        F.sum("growth").alias("growth_tokens"),
        F.count_if("is_boundary").alias("compactions"),
        pick(F.col("is_post"), F.col("ctx")).alias("post_ctx"),
        pick(F.col("is_post"), F.col("cache_creation")).alias("post_rewrite"),
        F.sum("summary_chars").cast("bigint").alias("summary_chars"),
        pick(reply, F.col("cache_1h")).alias("write_1h"),
        pick(reply, F.col("cache_creation") - F.col("cache_1h")).alias("write_5m"),
    )


def auto_window(daily: DataFrame, main_model: Column, floor: Column | None = None) -> DataFrame:
    """Cheapest compaction window for the measured growth, then raised above the start floor.

    Context climbs from ``base`` to window - margin between compactions; a bigger
    window makes reads dearer and compactions rarer.  The grid is an array
    inside the single totals row, so no join is needed.
    """
    names = ["growth_steps", "growth_tokens", "compactions", "post_ctx", "post_rewrite", "summary_chars", "write_1h", "write_5m", "replies"]
    t = daily.agg(*[F.sum(c).alias(c) for c in names]).withColumn("model", main_model)
    t = t.filter((F.col("compactions") >= R.MIN_COMPACTIONS) & (F.col("growth_steps") >= R.MIN_GROWTH_STEPS) & (F.col("growth_tokens") > 0))
    n = F.col("compactions")
    writes = F.col("write_1h") + F.col("write_5m")
    mult = F.when(writes > 0, (F.col("write_1h") * R.CACHE_WRITE_1H_MULT + F.col("write_5m") * R.CACHE_WRITE_5M_MULT) / writes)
    out_mult = P.output_price(F.col("model")) / P.input_price(F.col("model"))
    t = t.withColumns({"base": F.col("post_ctx") / n, "growth": F.col("growth_tokens") / F.col("growth_steps")})
    t = t.withColumn(
        "fixed",
        F.coalesce(mult, F.lit(R.CACHE_WRITE_1H_MULT)) * (F.col("post_rewrite") / n) + out_mult * (F.col("summary_chars") / n / 4),
    )
    grid = F.sequence(F.lit(R.MIN_WINDOW), F.lit(R.MAX_WINDOW), F.lit(R.WINDOW_STEP))
    t = t.withColumn("w", F.explode(grid))
    top = F.col("w") - R.COMPACT_BELOW
    gap = top - F.col("base")
    units = F.when(gap < R.MIN_GAP, F.lit(float("inf"))).otherwise(
        R.CACHE_READ_MULT * (F.col("base") + gap / 2) + (F.col("fixed") + R.CACHE_READ_MULT * top) * F.col("growth") / gap
    )
    best = t.withColumn("units", units).groupBy("base", "growth", "fixed", "compactions", "replies", "model").agg(
        F.min_by("w", F.struct("units", "w")).cast("bigint").alias("best")
    )
    need = F.lit(0) if floor is None else effective_floor(floor)
    return best.select(
        "best", "base", "growth",
        (F.col("fixed") + R.CACHE_READ_MULT * (F.col("best") - R.COMPACT_BELOW)).alias("compact_units"),
        "replies", "compactions", "model",
        F.greatest("best", F.coalesce(need, F.lit(0))).cast("bigint").alias("effective"),
    )


def effective_floor(floor: Column) -> Column:
    """Smallest window that leaves the margin above a start floor, rounded up to the grid."""
    need = F.ceil((floor + R.FLOOR_MARGIN) / R.WINDOW_STEP) * R.WINDOW_STEP
    return F.when(floor > 0, F.least(F.lit(R.MAX_WINDOW), need)).otherwise(0)


def baseline_overhead(replies: DataFrame) -> DataFrame:
    """Upper median of every session's first real reply; no row value below five sessions."""
    main = replies.filter(~F.col("is_sidechain") & (F.col("ctx") >= R.BASELINE_MIN_TOKENS))
    first = main.groupBy("session_id").agg(F.min_by("ctx", "seq").alias("ctx"))
    out = first.agg(
        F.count("*").alias("sessions"),
        # the lower median of the descending order is the upper median
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ctx DESC)").cast("bigint").alias("m"),
    )
    return out.select("sessions", F.when(F.col("sessions") >= R.BASELINE_MIN_SESSIONS, F.col("m")).alias("median_tokens"))


def since_last_boundary(items: DataFrame) -> DataFrame:
    """Rows at or after their session's last compaction (all rows when there was none)."""
    last = items.filter("is_boundary").groupBy("session_id").agg(F.max(F.struct(*ORDER)).alias("at"))
    joined = items.join(last, "session_id", "left")
    return joined.filter(F.col("at").isNull() | (F.struct(*ORDER) >= F.col("at"))).drop("at")


def context_breakdown(items: DataFrame, top: int = 3) -> DataFrame:
    """Tokens per kind of message still in context, share of the session and the top-consumer phrase."""
    live = since_last_boundary(items).filter("tokens > 0")
    per = live.groupBy("session_id", "label").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    total = W.partitionBy("session_id")
    rank = W.partitionBy("session_id").orderBy(F.col("tokens").desc(), "label")
    share = F.floor(F.col("tokens") * 100 / F.sum("tokens").over(total) + 0.5).cast("bigint")
    per = per.withColumns({"share": share, "rank": F.row_number().over(rank).cast("bigint")})
    # labels are a small fixed vocabulary per session, so this list is bounded by ``top``
    named = F.when(F.col("rank") <= top, F.struct("rank", F.concat("label", F.lit(" "), "share", F.lit("%")).alias("s")))
    listed = F.transform(F.array_sort(F.collect_list(named).over(total)), lambda x: x["s"])
    return per.withColumn("phrase", F.array_join(listed, ", "))


def biggest_items(items: DataFrame, k: int = 5, min_tokens: int = R.BIG_ITEM_TOKENS) -> DataFrame:
    live = since_last_boundary(items).filter(F.col("tokens") >= min_tokens)
    w = W.partitionBy("session_id").orderBy(F.col("tokens").desc(), *ORDER)
    return live.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def start_blocks(items: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Which start blocks (named by a marker text) are still in context after the last compaction."""
    live = since_last_boundary(items)
    return live.groupBy("session_id").agg(*[F.coalesce(F.bool_or(F.col("text").contains(m)), F.lit(False)).alias(n) for n, m in markers.items()])


def recall_budget(shown: DataFrame, budget: int) -> DataFrame:
    """Per session since the last compaction: recall tokens spent, distinct keys shown, tokens left.

    ``shown`` rows: is_boundary, key (null on boundaries), tokens.
    """
    live = since_last_boundary(shown).filter(F.col("key").isNotNull())
    per_key = live.groupBy("session_id", "key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return per_key.groupBy("session_id").agg(
        F.sum("tokens").alias("spent"),
        F.count("*").alias("distinct_keys"),
        F.sum("n").alias("shown"),
        F.greatest(F.lit(0), F.lit(budget) - F.sum("tokens")).cast("bigint").alias("left"),
    )


def injected_keys(shown: DataFrame) -> DataFrame:
    """Distinct (session, key) pairs already shown since the last compaction."""
    return since_last_boundary(shown).filter(F.col("key").isNotNull()).select("session_id", "key").distinct()
