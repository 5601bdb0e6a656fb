"""What agents did: lookups, repeats, claims, hints, skills, cache misses.

Event rows: session_id, ts, us, seq plus the columns each operator names.
Ordered state goes through ``with_carried`` so no session has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell import rules as R
from tracewell.functions import pricing as P
from tracewell.functions.commands import check_command, doing_command
from tracewell.functions.ordered import day_bucket, lag, last_value, running_max, running_sum, with_carried
from tracewell.session import written

KEY, ORDER = ["session_id"], ["ts", "seq"]
MINUTE_US = 60_000_000


def carried(df: DataFrame, columns, keys=KEY, bucket: Column | None = None) -> DataFrame:
    return with_carried(df, list(keys), ORDER, columns, day_bucket() if bucket is None else bucket)


def count(cond: Column) -> Column:
    return F.coalesce(cond.cast("bigint"), F.lit(0).cast("bigint"))


# --- lookups and nudges -------------------------------------------------------


def lookup_chains(replies: DataFrame, length: int = R.CHAIN_LENGTH) -> DataFrame:
    """Replies that end a run of ``length`` replies, each a single lookup with little text.

    ``replies``: n_tools, is_lookup, text_chars.
    """
    single = (F.col("n_tools") == 1) & F.col("is_lookup") & (F.col("text_chars") < R.CHAIN_MAX_TEXT)
    df = carried(replies.withColumn("single", single), [running_sum("n", F.lit(1).cast("bigint"))])
    df = carried(df, [last_value("broke_at", F.when(~F.col("single"), F.col("n")), True)])
    run = F.when(F.col("single"), F.col("n") - F.coalesce("broke_at", F.lit(0))).otherwise(0)
    return df.withColumn("run", run.cast("bigint")).withColumn("in_chain", F.col("run") >= length).drop("n", "broke_at", "single")


def rate_limited(events: DataFrame, per_session: int = R.NUDGES_PER_SESSION, gap_minutes: int = R.NUDGE_GAP_MINUTES) -> DataFrame:
    """At most ``per_session`` emissions, each at least the gap after the last emitted one.

    Each round takes every session's earliest allowed event, so the greedy
    choice needs ``per_session`` small aggregates and no per-session list.
    """
    first = events.groupBy("session_id").agg(F.min(F.struct("us", "seq")).alias("e"))
    rounds = [first]
    for _ in range(per_session - 1):
        prev = rounds[-1].select("session_id", F.col("e.us").alias("p_us"))
        later = events.join(prev, "session_id").filter(F.col("us") - F.col("p_us") >= gap_minutes * MINUTE_US)
        rounds.append(later.groupBy("session_id").agg(F.min(F.struct("us", "seq")).alias("e")))
    out = None
    for i, r in enumerate(rounds, 1):
        r = r.select("session_id", F.lit(i).cast("bigint").alias("nth"), F.col("e.us").alias("us"), F.col("e.seq").alias("seq"))
        out = r if out is None else out.unionByName(r)
    return out


# --- repeats ------------------------------------------------------------------


def screenshot_key(tool: Column, call_input: Column) -> Column:
    """Stable key of a screenshot call, null for other tools."""
    shot = tool.rlike(r"(?i)^mcp__.*screenshot") | (tool.startswith("mcp__") & call_input.rlike(r'(?i)"action"\s*:\s*"screenshot"'))
    return F.when(shot, F.sha1(F.concat_ws("|", tool, call_input)))


def repeat_calls(events: DataFrame, window_minutes: float = R.REREAD_WINDOW_MINUTES, by_path: bool = True) -> DataFrame:
    """Calls that repeat an unchanged earlier call of the same key; the second ask in a row passes.

    ``events``: key (null unless a guarded call), path, version, is_change, is_boundary.
    A change of the same path (or any change for screenshots) in between makes the call new.
    """
    scope = ["session_id", "path"] if by_path else KEY
    df = carried(events, [running_sum("epoch", count(F.col("is_boundary")))])
    df = carried(df, [running_sum("changes", count(F.col("is_change")))], keys=scope)
    calls = df.filter(F.col("key").isNotNull())
    keys = ["session_id", "key"]
    state = F.struct("us", "epoch", "changes", "version")
    calls = carried(calls, [lag("prev", state), running_sum("n", F.lit(1).cast("bigint"))], keys=keys)
    prev = F.col("prev")
    same = (
        prev.isNotNull()
        & (prev["epoch"] == F.col("epoch"))
        & (prev["changes"] == F.col("changes"))
        & prev["version"].eqNullSafe(F.col("version"))
        & (F.col("us") - prev["us"] < window_minutes * MINUTE_US)
    )
    calls = calls.withColumn("same", F.coalesce(same, F.lit(False)))
    calls = carried(calls, [last_value("fresh_at", F.when(~F.col("same"), F.col("n")), True)], keys=keys)
    odd = (F.col("n") - F.col("fresh_at")) % 2 == 1
    return calls.withColumn("is_repeat", F.col("same") & odd).drop("prev", "n", "fresh_at", "same", "changes")


def large_reads(reads: DataFrame, max_bytes: int = R.LARGE_READ_BYTES) -> DataFrame:
    """Un-ranged reads above the limit and the tokens a ranged read would have saved."""
    cost = F.ceil(F.col("size") / R.CHARS_PER_TOKEN_PROSE).cast("bigint")
    big = reads.filter(~F.col("ranged") & (F.col("size") > max_bytes))
    return big.withColumn("tokens", F.greatest(F.lit(0), cost - 600).cast("bigint"))


# --- turns --------------------------------------------------------------------


def with_turn(events: DataFrame) -> DataFrame:
    """Turn number: prompts seen so far in the session."""
    return carried(events, [running_sum("turn", count(F.col("is_prompt")))])


def edits_per_turn(events: DataFrame) -> DataFrame:
    """Distinct code files edited since each prompt."""
    code = F.col("is_edit") & ~F.col("path").rlike(R.NON_CODE_FILE)
    files = with_turn(events).filter(code).groupBy("session_id", "turn", "path").agg(F.count("*").alias("n"))
    return files.groupBy("session_id", "turn").agg(F.count("*").alias("files"), F.sum("n").alias("edits"))


def claims_success(text: Column) -> Column:
    return text.rlike(R.SUCCESS_CLAIM) & ~text.rlike(R.HONEST_PHRASE)


def claims_without_proof(events: DataFrame, per_session: int = R.CLAIMS_PER_SESSION) -> DataFrame:
    """Turns whose last reply claims success although nothing ran after the last edit.

    ``events``: is_prompt, is_edit, is_cmd, verify_ok (boolean, null when not a check), text (replies), path.
    """
    at = F.struct(*ORDER)
    turns = (
        with_turn(events)
        .groupBy("session_id", "turn")
        .agg(
            F.max(F.when(F.col("is_edit") & ~F.col("path").rlike(R.NON_CODE_FILE), at)).alias("edit_at"),
            F.max(F.when(F.col("is_cmd"), at)).alias("cmd_at"),
            F.coalesce(F.bool_or(F.col("verify_ok").isNotNull()), F.lit(False)).alias("checked"),
            F.max_by("text", F.when(F.col("text").isNotNull(), at)).alias("text"),
        )
    )
    quiet = F.col("edit_at").isNotNull() & ~F.col("checked") & (F.col("cmd_at").isNull() | (F.col("cmd_at") < F.col("edit_at")))
    hits = turns.filter(quiet & claims_success(F.col("text")))
    w = W.partitionBy("session_id").orderBy("turn")
    return hits.withColumn("nth", F.row_number().over(w).cast("bigint")).filter(F.col("nth") <= per_session)


def session_rollup(events: DataFrame) -> DataFrame:
    """Start, end, prompts, commands, first prompt, last reply and weight per session."""
    at = F.struct(*ORDER)
    prompts = F.count_if("is_prompt")
    return events.groupBy("session_id").agg(
        F.min("us").alias("started_us"),
        F.max("us").alias("ended_us"),
        prompts.alias("prompts"),
        F.count_if("is_cmd").alias("commands"),
        F.min_by("text", F.when(F.col("is_prompt"), at)).alias("label"),
        F.max_by("text", F.when(F.col("is_reply"), at)).alias("outcome"),
        (1 + F.least(F.lit(3.0), prompts / 4)).alias("weight"),
    )


def open_todos(events: DataFrame) -> DataFrame:
    """Unfinished items of each session's last todo list."""
    last = events.filter(F.col("todos").isNotNull()).groupBy("session_id").agg(F.max_by("todos", F.struct(*ORDER)).alias("todos"))
    items = last.select("session_id", F.posexplode("todos").alias("pos", "t"))
    return items.filter(F.col("t.status") != "completed").select(
        "session_id", F.col("pos").cast("bigint").alias("pos"), F.col("t.status").alias("status"), F.col("t.content").alias("content")
    )


# --- hints --------------------------------------------------------------------


def hint_adoption(events: DataFrame) -> DataFrame:
    """Navigation hints and whether a ranged read of the hinted file followed.

    A later read exists exactly when the newest one is later, so the range join
    becomes an equi-join on (session, path) with one row per pair.
    """
    reads = events.filter(F.col("is_ranged_read")).groupBy("session_id", "path").agg(F.max("seq").alias("read_seq"))
    hints = events.filter(F.col("is_hint"))
    joined = hints.join(reads, ["session_id", "path"], "left")
    return joined.withColumn("followed", F.coalesce(F.col("read_seq") > F.col("seq"), F.lit(False))).drop("read_seq")


def recall_usefulness(hints: DataFrame, touches: DataFrame) -> DataFrame:
    """Per session: hints with files, and how many had a hinted file touched at or after them."""
    newest = touches.groupBy("session_id", "path").agg(F.max("us").alias("t_us"))
    each = hints.select("session_id", "seq", "us", F.explode("files").alias("path"))
    hit = each.join(newest, ["session_id", "path"], "left").withColumn("hit", F.coalesce(F.col("t_us") >= F.col("us"), F.lit(False)))
    per = hit.groupBy("session_id", "seq").agg(F.bool_or("hit").alias("hit"))
    return per.groupBy("session_id").agg(F.count("*").alias("shown"), F.count_if("hit").alias("hit"))


def strictness_fold(batches: DataFrame) -> DataFrame:
    """Final strictness per project after its ordered batches of (shown, hit).

    The fold is a bounded recurrence, so it runs over one pre-aggregated row per
    project and day, never over raw events.
    """
    seq = F.array_sort(F.collect_list(F.struct("batch", F.col("shown").cast("double").alias("shown"), F.col("hit").cast("double").alias("hit"))))
    start = F.struct(F.lit(0.0).alias("shown"), F.lit(0.0).alias("hit"), F.lit(1.0).alias("strict"))

    def step(acc, x):
        shown, hit = acc["shown"] + x["shown"], acc["hit"] + x["hit"]
        half = F.when(shown > R.STRICT_WINDOW, 0.5).otherwise(1.0)
        shown, hit = shown * half, hit * half
        rate = hit / shown
        move = F.when(rate < 0.2, 0.1).when(rate > 0.5, -0.1).otherwise(0.0)
        nxt = F.greatest(F.lit(R.STRICT_MIN), F.least(F.lit(R.STRICT_MAX), acc["strict"] + move))
        nxt = F.floor(nxt * 100 + 0.5) / 100
        return F.struct(shown.alias("shown"), hit.alias("hit"), F.when(shown < R.STRICT_SAMPLE, acc["strict"]).otherwise(nxt).alias("strict"))

    out = batches.filter("shown > 0").groupBy("project").agg(F.aggregate(seq, start, step).alias("s"))
    return out.select("project", F.col("s.shown").alias("shown"), F.col("s.hit").alias("hit"), F.col("s.strict").alias("strictness"))


# --- skills and plugins -------------------------------------------------------


def skill_idle_plan(listings: DataFrame, uses: DataFrame, overrides: list[str], as_of_us: Column, min_days: int = 7) -> DataFrame:
    """Plugin skills of the newest listing that nobody used, old enough to judge and not overridden.

    ``listings``: us, name, chars (description); ``uses``: name.
    """
    cutoff = as_of_us - min_days * 86_400_000_000
    newest = listings.agg(F.max("us")).scalar()
    per = listings.groupBy("name").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("chars", "us").alias("chars"))
    oldest = listings.agg(F.min("us")).scalar()
    current = per.filter(
        (F.col("last_us") == newest) & F.col("name").contains(":") & (F.col("first_us") <= cutoff) & (oldest <= cutoff)
    ).filter(~F.col("name").isin(overrides) if overrides else F.lit(True))
    used = uses.select("name").distinct()
    bare = F.regexp_extract("name", r"([^:]*)$", 1)
    idle = current.join(used, "name", "left_anti").withColumn("bare", bare)
    idle = idle.join(used.withColumnRenamed("name", "bare"), "bare", "left_anti")
    return idle.select("name", "chars", F.floor(F.col("chars") / 4 + 0.5).cast("bigint").alias("saved_tokens"))


def owner_of(name: Column, plugins: list[str]) -> Column:
    """The installed plugin with the longest name that prefixes ``name``."""
    out = F.lit(None).cast("string")
    for p in sorted(plugins, key=len):
        hit = name.startswith(f"{p}:") | name.startswith(f"plugin:{p}:") | name.startswith(f"mcp__plugin_{p}_")
        out = F.when(hit, p).otherwise(out)
    return out


def plugin_usage(plugins: list[str], off: list[str], listings: DataFrame, uses: DataFrame, as_of_us: Column, min_days: int = 7) -> DataFrame:
    """Uses, listing cost and status of every installed plugin.

    ``listings``: session_id, us, name, chars; ``uses``: name.
    """
    spark = listings.sparkSession
    cutoff = as_of_us - min_days * 86_400_000_000
    names = spark.createDataFrame([(p,) for p in plugins], "plugin string")
    used = uses.groupBy("name").agg(F.count("*").alias("n")).withColumn("plugin", owner_of(F.col("name"), plugins))
    used = used.filter("plugin is not null").groupBy("plugin").agg(F.sum("n").alias("uses"))
    listed = listings.withColumn("plugin", owner_of(F.col("name"), plugins)).filter("plugin is not null")
    cost = listed.groupBy("plugin", "session_id").agg(F.sum("chars").alias("chars"), F.min("us").alias("first_us"))
    cost = cost.groupBy("plugin").agg(F.max("chars").alias("chars"), F.min("first_us").alias("first_us"))
    oldest = listings.agg(F.min("us")).scalar()
    zero = F.lit(0).cast("bigint")
    rows = names.join(used, "plugin", "left").join(cost, "plugin", "left")
    status = (
        F.when(F.col("plugin").isin(off), "off")
        .when(F.col("uses") > 0, "used")
        .when(F.col("first_us").isNull(), "unseen")
        .when((F.col("first_us") > cutoff) | (oldest > cutoff), "new")
        .otherwise("disable")
    )
    tokens = F.floor(F.coalesce("chars", zero) / 4 + 0.5).cast("bigint")
    return rows.select("plugin", F.coalesce("uses", zero).alias("uses"), tokens.alias("tokens"), status.alias("status"))


def distinct_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Exact distinct counts, each pre-aggregated before the count."""
    return df.agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in cols])


def approx_distinct_counts(df: DataFrame, *cols: str, rsd: float = 0.02) -> DataFrame:
    """Sketch-based distinct counts for logs where an exact answer is not needed."""
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(f"distinct_{c}") for c in cols])


# --- tool calls ---------------------------------------------------------------


def tool_call_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call with the result that answers it."""
    return calls.join(results, ["session_id", "call_id"])


def output_by_command(pairs: DataFrame, top: int = 15, example_chars: int | None = None) -> DataFrame:
    """Where tool-output tokens go, by command key; ``pairs`` has key, command, chars, shortened, us, call_id.

    The example is a whole command (white space as one space) unless a number of characters is given.
    """
    tokens = F.floor(F.col("chars") / R.CHARS_PER_REMOVED_TOKEN + 0.5).cast("bigint")
    df = pairs.withColumn("tok", tokens).filter("tok > 0")
    example = F.regexp_replace("command", r"\s+", " ")
    example = example if example_chars is None else F.substring(example, 1, example_chars)
    rows = df.groupBy("key").agg(
        F.count("*").alias("runs"),
        F.sum("tok").alias("tokens"),
        F.sum(F.when(F.col("shortened"), F.col("tok")).otherwise(0)).alias("shortened_tokens"),
        F.max("tok").alias("max_tokens"),
        F.max_by(example, F.struct("tok", -F.col("us"), -F.col("call_id"))).alias("example"),
    )
    return rows.orderBy((F.col("tokens") - F.col("shortened_tokens")).desc(), "key").limit(top)


def last_check_calls(calls: DataFrame) -> DataFrame:
    """Newest check command per session (call_id, check)."""
    checks = calls.withColumn("check", check_command(F.col("command"))).filter("check is not null")
    at = F.struct("us", "call_id")
    return checks.groupBy("session_id").agg(F.max_by(F.struct("call_id", "check", "us"), at).alias("c")).select("session_id", "c.*")


def last_check(calls: DataFrame, results: DataFrame, edits: DataFrame, failed: str = R.CHECK_FAILED, passed: str = R.CHECK_PASSED, line_chars: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Verdict of each session's last check from its output, with the evidence line and edits since.

    Only the last check's output is read line by line; the line is whole unless a number of characters is given.
    ``results``: session_id, call_id, is_error and text.  Where texts are kept apart, ``texts`` has them, and
    the other columns that both have name a result's text: then only texts of last checks meet a result.
    """
    last = written(last_check_calls(calls), "last")
    if texts is None:
        out = last.join(results.select("session_id", "call_id", "text", "is_error"), ["session_id", "call_id"])
    else:
        name = [c for c in texts.columns if c != "text"]
        of = written(last.join(results.select("session_id", "call_id", "is_error", *name), ["session_id", "call_id"]), "of")
        out = of.join(texts, name).drop(*name)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    failing = lambda s: F.regexp_replace(s, r"(?i)\b0 failed\b", "").rlike(failed)
    bad = F.col("is_error") | failing(F.col("text"))
    out = out.withColumns({"lines": lines, "bad": bad})
    hits = F.filter("lines", failing)
    first = F.coalesce(F.get(hits, F.lit(0)), F.get("lines", F.lit(0)), F.lit(""))
    good = F.coalesce(F.try_element_at(F.filter("lines", lambda s: s.rlike(passed)), F.lit(-1)), F.lit(""))
    line = F.when(F.col("bad"), first).otherwise(good)
    line = line if line_chars is None else F.substring(line, 1, line_chars)
    verdict = F.when(F.col("bad"), "FAILED").when(line != "", "passed").otherwise("no failure output")
    out = out.withColumns({"line": line, "verdict": verdict}).drop("lines", "text", "is_error", "bad")
    since = edits.join(out.select("session_id", F.col("us").alias("c_us")), "session_id").filter(F.col("us") > F.col("c_us"))
    since = since.groupBy("session_id").agg(F.count("*").alias("edits_since"))
    return out.join(since, "session_id", "left").withColumn("edits_since", F.coalesce("edits_since", F.lit(0).cast("bigint")))


def recent_commands(calls: DataFrame, k: int = 5) -> DataFrame:
    """Last ``k`` different commands per session that changed or verified something."""
    lines = calls.withColumn("line", doing_command(F.col("command"))).filter("line is not null")
    newest = lines.groupBy("session_id", "line").agg(F.max(F.struct("us", "call_id")).alias("at"))
    w = W.partitionBy("session_id").orderBy(F.col("at").desc())
    return newest.withColumn("nth", F.row_number().over(w).cast("bigint")).filter(F.col("nth") <= k).select("session_id", "line", "nth")


def slow_checks(runs: DataFrame, limit_ms: int) -> DataFrame:
    """Checks whose last two runs both exceeded the limit, or that ever timed out.

    ``runs``: project, command, ts, seq, ms, timed_out.
    """
    df = carried(runs, [lag("prev_ms", F.col("ms"))], keys=["project", "command"])
    out = df.groupBy("project", "command").agg(
        F.count("*").alias("runs"),
        F.max_by(F.struct("ms", "prev_ms"), F.struct(*ORDER)).alias("last"),
        F.bool_or("timed_out").alias("timed_out"),
    )
    twice = (F.col("last.ms") > limit_ms) & F.coalesce(F.col("last.prev_ms") > limit_ms, F.lit(False))
    return out.filter(twice | F.col("timed_out")).select("project", "command", "runs", "timed_out", twice.alias("slow_twice"))


def repeat_failures(checks: DataFrame, rounds: int = R.VERIFY_ROUNDS) -> DataFrame:
    """Failed checks with whether they are reported: new fingerprint in the session and within the turn's rounds.

    ``checks``: is_prompt, failed, fp.
    """
    df = with_turn(checks).filter("failed")
    df = carried(df, [running_sum("round", F.lit(1).cast("bigint"))], keys=["session_id", "turn"])
    first = df.groupBy("session_id", "fp").agg(F.min(F.struct(*ORDER)).alias("first_at"))
    df = df.join(first, ["session_id", "fp"])
    seen = F.struct(*ORDER) > F.col("first_at")
    return df.withColumns({"seen_before": seen, "reported": ~seen & (F.col("round") <= rounds)}).drop("first_at")


# --- other clients ------------------------------------------------------------


def normalize_tool(name: Column, tools: dict[str, str] = R.FOREIGN_TOOLS) -> Column:
    """A foreign tool name in the common vocabulary; unknown names stay."""
    pairs = [F.lit(x) for kv in tools.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def pair_fifo(steps: DataFrame) -> DataFrame:
    """Pair the k-th waiting call of a turn with the k-th result that found one waiting.

    A result with nothing waiting is dropped: that is where (results - calls)
    reaches a new maximum above zero, so the queue needs running sums only.
    ``steps``: is_prompt, is_call, is_result, step_id.
    """
    turn = ["session_id", "turn"]
    df = with_turn(steps).filter(F.col("is_call") | F.col("is_result"))
    df = carried(df, [running_sum("calls", count(F.col("is_call"))), running_sum("results", count(F.col("is_result")))], keys=turn)
    df = df.withColumn("over", F.col("results") - F.col("calls"))
    df = carried(df, [running_max("over_before", F.col("over"))], keys=turn)
    before = F.greatest(F.lit(0), F.coalesce("over_before", F.lit(0)))
    calls = df.filter("is_call").select(*turn, F.col("calls").alias("k"), F.col("step_id").alias("call_id"), "tool")
    results = df.filter(F.col("is_result") & (F.col("over") <= before))
    results = results.select(*turn, (F.col("results") - before).alias("k"), F.col("step_id").alias("result_id"))
    return calls.join(results, [*turn, "k"], "left")


def dedupe_foreign(rows: DataFrame) -> DataFrame:
    """Drop a prompt or reply equal to the one before and repeated token totals; split cached out of input.

    ``rows``: kind (prompt, reply, usage), body (text or total), input_tokens, cached_tokens, output_tokens.
    """
    df = carried(rows, [lag("prev_body", F.col("body"))], keys=["session_id", "kind"])
    repeat = F.col("prev_body").eqNullSafe(F.col("body")) & ~((F.col("kind") == "usage") & (F.col("body") == "0"))
    fresh = F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_tokens")).cast("bigint")
    return df.filter(~repeat).drop("prev_body").withColumn("fresh_input", F.when(F.col("kind") == "usage", fresh))


def patch_files(patch: Column) -> Column:
    """Distinct files named in a patch body."""
    named = F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:(?:Update|Add|Delete) File|Move to): (.+)$"), F.lit(1))
    return F.array_distinct(F.transform(named, lambda f: F.trim(f)))


# --- alerts -------------------------------------------------------------------


def alert_level(value: Column, first: int) -> Column:
    """1 at the first limit, one more for each doubling, null below."""
    # binary digits of the quotient count its doublings exactly, however large it is
    return F.when(value >= first, F.length(F.bin(F.floor(value / first))).cast("bigint"))


def alert_levels(events: DataFrame, first: int) -> DataFrame:
    """Rows whose level is above every earlier one since the last reset, with items and tokens so far.

    ``events``: value, is_boundary.
    """
    df = carried(events, [running_sum("epoch", count(F.col("is_boundary")))])
    df = df.filter(~F.col("is_boundary")).withColumn("level", alert_level(F.col("value"), first))
    one = F.lit(1).cast("bigint")
    cols = [running_max("top", F.col("level")), running_sum("items", one), running_sum("total", F.col("value"))]
    df = carried(df, cols, keys=["session_id", "epoch"])
    return df.filter(F.col("level") > F.coalesce("top", F.lit(0))).drop("top")


# --- cache misses -------------------------------------------------------------


def first_difference(a: Column, b: Column) -> Column:
    """1-based position where two strings part, null when equal."""
    # lengths that differ pad with null, hence the null-safe comparison
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    pos = F.array_position(same, F.lit(False))
    return F.when(pos > 0, pos)


def cache_miss_diagnosis(requests: DataFrame, bucket: Column | None = None) -> DataFrame:
    """First reason why a follow-up request wrote the cache instead of reading it.

    ``requests``: conv, ts, seq, us, model, tools (array), system, msgs (array), cache_creation, cache_1h, cache_read.
    """
    state = F.struct("us", "model", "tools", "system", "msgs")
    df = with_carried(requests, ["conv"], ORDER, [lag("prev", state)], day_bucket() if bucket is None else bucket)
    write = F.col("cache_creation")
    df = df.filter(F.col("prev").isNotNull() & (write >= R.MISS_MIN_WRITE) & (write >= F.col("cache_read") * 0.5))
    prev = F.col("prev")
    changed = F.array_position(
        F.slice(
            F.zip_with(prev["msgs"], F.col("msgs"), lambda x, y: x.eqNullSafe(y)), 1, F.least(F.size(prev["msgs"]), F.size("msgs"))
        ),
        F.lit(False),
    )
    ttl = F.when(F.col("cache_1h") > 0, R.TTL_LONG_MINUTES).otherwise(R.TTL_SHORT_MINUTES)
    idle = (F.col("us") - prev["us"]) / MINUTE_US
    culprit = (
        F.when(prev["model"] != F.col("model"), "model-switch")
        .when(prev["tools"] != F.col("tools"), "tools-changed")
        .when(prev["system"] != F.col("system"), "system-changed")
        .when(changed > 0, "history-edited")
        .when(idle > ttl, "expired")
        .otherwise("unknown")
    )
    wasted = write * P.input_price(F.col("model")) * (P.cache_write_mult(write, F.col("cache_1h")) - R.CACHE_READ_MULT) / 1e6
    diff = first_difference(prev["system"], F.col("system"))
    start = F.greatest(F.lit(1), diff - 40).cast("int")
    now = F.substring(F.col("system"), start, F.lit(100))
    volatile = F.concat(F.substring(prev["system"], start, F.lit(100)), now).rlike(
        r"(?i)\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2}|[0-9a-f]{8}-[0-9a-f]{4}|\b\d{10,13}\b"
    )
    is_system = F.col("culprit") == "system-changed"
    is_tools = F.col("culprit") == "tools-changed"
    names = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return df.withColumns({"culprit": culprit, "wasted_usd": wasted}).withColumns(
        {
            "added": F.when(is_tools, names(F.col("tools"), prev["tools"])),
            "removed": F.when(is_tools, names(prev["tools"], F.col("tools"))),
            "message_no": F.when(F.col("culprit") == "history-edited", changed),
            "diff_at": F.when(is_system, diff),
            "volatile": F.when(is_system, volatile),
        }
    ).drop("prev")


# --- comparisons and messages -------------------------------------------------


def arm_compare(results: DataFrame) -> DataFrame:
    """Pass rate, cost and tokens per arm, saving of the on arm and tasks that regressed."""
    per = results.groupBy("arm").agg(
        F.count("*").alias("n"),
        F.count_if("passed").alias("passed"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("tokens").alias("tokens"),
    )
    off_cost = per.filter(F.col("arm") == "off").select("cost_usd").scalar()
    off_ok = results.filter((F.col("arm") == "off") & F.col("passed")).select("task").distinct()
    worse = results.filter((F.col("arm") == "on") & ~F.col("passed")).select("task").distinct().join(off_ok, "task", "left_semi")
    n_worse = worse.agg(F.count("*")).scalar()
    on = F.col("arm") == "on"
    saved = F.when(on & (off_cost > 0), F.round((1 - F.col("cost_usd") / off_cost) * 100, 6))
    return per.withColumns({"saved_pct": saved, "regressed_tasks": F.when(on, n_worse)})


def unanswered_messages(sent: DataFrame, delivered: DataFrame, replied: DataFrame) -> DataFrame:
    """Messages without a reply, with whether they were delivered; all keyed by (session_id, id)."""
    keys = ["session_id", "id"]
    got = delivered.select(*keys).distinct().withColumn("delivered", F.lit(True))
    open_ = sent.join(replied, keys, "left_anti").join(got, keys, "left")
    return open_.withColumn("delivered", F.coalesce("delivered", F.lit(False)))


def take_handoff(handoffs: DataFrame, requests: DataFrame, as_of_us: Column, max_hours: int = 48) -> DataFrame:
    """For each (project, session) request the newest unconsumed handoff of the project.

    A session may take its own only after a compaction, so per project just the
    newest handoff and the newest one of a different session matter.
    """
    live = handoffs.filter(~F.col("consumed") & (F.col("us") >= as_of_us - max_hours * 3_600_000_000))
    best = live.groupBy("project", "session_id").agg(F.max(F.struct("us", "handoff_id")).alias("at"))
    w = W.partitionBy("project").orderBy(F.col("at").desc(), "session_id")
    two = best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    pick = lambda i: F.max(F.when(F.col("rn") == i, F.struct("session_id", F.col("at.handoff_id").alias("id"))))
    two = two.groupBy("project").agg(pick(1).alias("one"), pick(2).alias("two"))
    own = (F.col("one.session_id") == F.col("session_id")) & ~F.col("after_compact")
    chosen = F.when(own, F.col("two.id")).otherwise(F.col("one.id"))
    out = requests.join(two, "project").withColumn("handoff_id", chosen)
    return out.filter(F.col("handoff_id").isNotNull()).drop("one", "two")


def resolve_session(names: DataFrame, sessions: DataFrame) -> DataFrame:
    """The live session a name means: id, id prefix, path, folder, part of the folder; newest wins a tie.

    Every rule is an equi-join on a key expanded from the session side, so no
    name is compared with every session.  ``sessions``: sid, cwd, us.
    """
    folder = F.lower(F.regexp_extract("cwd", r"([^/]*)/*$", 1))
    s = sessions.withColumn("folder", folder)
    n = F.length("folder")
    pieces = F.expr(
        "array_distinct(flatten(transform(sequence(1, length(folder)), "
        "i -> transform(sequence(1, length(folder) - i + 1), l -> substring(folder, i, l)))))"
    )
    prefixes = F.expr("transform(sequence(6, greatest(6, length(sid))), l -> substring(sid, 1, l))")
    keys = [
        (1, s.select("*", F.col("sid").alias("key"))),
        (2, s.select("*", F.explode(F.array_distinct(prefixes)).alias("key"))),
        (3, s.select("*", F.regexp_replace("cwd", "/+$", "").alias("key"))),
        (4, s.select("*", F.col("folder").alias("key"))),
        (5, s.filter(n > 0).select("*", F.explode(pieces).alias("key"))),
    ]
    best = None
    for rank, df in keys:
        df = df.groupBy("key").agg(F.max_by("sid", F.struct("us", "sid")).alias("sid"))
        df = df.select("key", F.lit(rank).alias("rank"), "sid")
        best = df if best is None else best.unionByName(df)
    named = names.select("name", F.trim("name").alias("t")).distinct()
    raw = named.withColumn("key", F.col("t")).join(best.filter(F.col("rank") <= 2), "key")
    path = named.withColumn("key", F.regexp_replace("t", "/+$", "")).join(best.filter(F.col("rank") == 3), "key")
    low = named.withColumn("key", F.lower("t")).join(best.filter(F.col("rank") >= 4), "key")
    hits = raw.unionByName(path).unionByName(low)
    hits = hits.filter((F.col("rank") != 2) | (F.length("t") >= 6)).filter(F.col("t") != "")
    found = hits.groupBy("name").agg(F.min_by("sid", "rank").alias("sid"), F.min("rank").cast("bigint").alias("rule"))
    only = sessions.agg(F.when(F.count("*") == 1, F.max("sid"))).scalar()
    blank = named.filter(F.col("t") == "").select("name", only.alias("sid"), F.lit(0).cast("bigint").alias("rule"))
    return found.unionByName(blank.filter("sid is not null"))


def duplicate_results(results: DataFrame, min_chars: int = 2000) -> DataFrame:
    """Later copies of a long tool result in a conversation, with the message to point at.

    Grouping by (conversation, hash) keeps the first message; texts never reach the shuffle.
    """
    slim = results.filter(F.length("text") >= min_chars).select("conv", "message", F.length("text").alias("chars"), F.sha1("text").alias("sha"))
    first = slim.groupBy("conv", "sha").agg(F.min("message").alias("first_message"))
    copies = slim.join(first, ["conv", "sha"]).filter(F.col("message") > F.col("first_message"))
    return copies.select("conv", "message", "first_message", "chars")


def new_errors(before: DataFrame, after: DataFrame, show: int = 6) -> DataFrame:
    """Diagnostics after an edit that were not there before, by (file, code, message) without line numbers.

    The first ``show`` per file group carry ``listed``; all are returned with the group's count.
    """
    fp = ["file", "code", "message"]
    fresh = after.join(before.select(*fp).distinct(), fp, "left_anti")
    per = fresh.groupBy("grp").agg(F.count("*").alias("n_new"), F.min(F.struct("line", "code", "message")).alias("first"))
    w = W.partitionBy("grp").orderBy("line", "code", "message")
    listed = fresh.withColumn("nth", F.row_number().over(w).cast("bigint")).filter(F.col("nth") <= show)
    return listed.join(per.select("grp", "n_new"), "grp").withColumn("more", F.greatest(F.lit(0), F.col("n_new") - show).cast("bigint"))
