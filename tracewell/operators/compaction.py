"""Shorter tool output: line runs, head/tail cuts, build noise, test summaries, JSON lists.

A text is one row, so most steps are array expressions over its lines with no
shuffle at all.  Only the test summary works on a line table, after the length
and runner filters, with windows inside one text.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell import rules as R
from tracewell.functions.commands import command_parts, wants_content
from tracewell.functions.text import removed_tokens, token_estimate
from tracewell.session import written


def slice_text(text: Column, start: Column, end: Column | None = None) -> Column:
    """Zero-based [start, end)."""
    n = F.greatest(F.lit(0), (F.length(text) if end is None else end) - start)
    return F.substring(text, (start + 1).cast("int"), n.cast("int"))


def is_numbered_read(text: Column) -> Column:
    """Line-numbered file output, which is never altered."""
    head = F.slice(F.split(text, "\n", 6), 1, 5)
    hits = F.size(F.filter(head, lambda s: s.rlike(R.NUMBERED_LINE)))
    return hits >= F.least(F.lit(3), F.size(head))


def clean_line(line: Column) -> Column:
    """What survives the last carriage return, without trailing blanks."""
    last = F.try_element_at(F.filter(F.split(line, "\r"), lambda p: p != ""), F.lit(-1))
    kept = F.when(line.contains("\r"), F.coalesce(last, F.lit(""))).otherwise(line)
    return F.regexp_replace(kept, r"[ \t]+$", "")


def _runs(df: DataFrame, lines: str) -> DataFrame:
    """Add ``__starts``: positions where a line differs from the one before."""
    pos = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(pos, lambda i: (i == 0) | ~F.get(F.col(lines), i).eqNullSafe(F.get(F.col(lines), i - 1)))
    return df.withColumn("__starts", starts)


def collapse_runs(df: DataFrame, text: str = "text", out: str = "collapsed", min_run: int = 3) -> DataFrame:
    """Clean lines and replace runs of identical non-blank lines by one line and its count."""
    t = F.regexp_replace(F.col(text), R.ANSI, "")
    df = df.withColumn("__lines", F.transform(F.split(t, "\n"), clean_line))
    df = _runs(df, "__lines")
    n = F.size("__lines")

    def emit(start, i):
        run = F.coalesce(F.get(F.col("__starts"), i + 1), n) - start
        line = F.get(F.col("__lines"), start)
        one = F.array(F.concat(line, F.lit("  [×"), run.cast("string"), F.lit("]")))
        return F.when((run >= min_run) & line.rlike(r"\S"), one).otherwise(F.array_repeat(line, run))

    joined = F.array_join(F.flatten(F.transform("__starts", emit)), "\n")
    done = F.regexp_replace(joined, r"\n{4,}", "\n\n\n")
    untouched = (F.length(text) < R.TRIM_MIN_CHARS) | is_numbered_read(F.col(text))
    return df.withColumn(out, F.when(untouched, F.col(text)).otherwise(done)).drop("__lines", "__starts")


def head_tail_cut(
    df: DataFrame,
    text: str = "text",
    out: str = "cut",
    threshold: Column | int = R.TRIM_THRESHOLD_CHARS,
    head: int = R.TRIM_HEAD_CHARS,
    tail: int = R.TRIM_TAIL_CHARS,
    problem: str = R.PROBLEM_LINE,
) -> DataFrame:
    """Keep the head and tail of an over-long text at line ends, and problem lines from the hidden middle."""
    t, n = F.col(text), F.length(text)
    first = F.substring(t, 1, head + 1)
    back = F.instr(F.reverse(first), "\n")
    head_end = F.when(back > 0, F.length(first) - back).otherwise(-1)
    h = F.when(head_end > 0, head_end).otherwise(head)
    from_ = n - tail
    found = F.locate("\n", slice_text(t, from_)) - 1
    tail_start = F.when(found >= 0, from_ + found).otherwise(-1)
    s = F.when(tail_start > h, tail_start).otherwise(from_)
    df = df.withColumns({"__h": h, "__s": s})
    df = df.withColumn("__cut", F.split(slice_text(t, F.col("__h"), F.col("__s")), "\n"))
    clip = lambda x: F.when(F.length(x) > R.TRIM_PROBLEM_LINE_CHARS, F.concat(F.substring(x, 1, R.TRIM_PROBLEM_LINE_CHARS), F.lit("…"))).otherwise(x)
    kept = F.transform(F.slice(F.filter("__cut", lambda x: x.rlike(problem)), 1, R.TRIM_PROBLEM_LINES), clip)
    df = df.withColumn("__kept", kept)
    note = F.concat(
        F.lit("\n\n["), F.size("__cut").cast("string"), F.lit(" lines ("), (F.col("__s") - F.col("__h")).cast("string"), F.lit(" chars) hidden]\n"),
    )
    problems = F.when(F.size("__kept") > 0, F.concat(F.lit("[problem lines from the hidden part]\n"), F.array_join("__kept", "\n"), F.lit("\n"))).otherwise("")
    cut = F.concat(F.substring(t, F.lit(1), F.col("__h")), note, problems, F.lit("\n"), slice_text(t, F.col("__s")))
    return df.withColumn(out, F.when(n > threshold, cut).otherwise(t)).drop("__h", "__s", "__cut", "__kept")


def trim_output(df: DataFrame, text: str, out: str, threshold: Column | int, problem: str = R.PROBLEM_LINE) -> DataFrame:
    """Collapse runs, then cut; short and line-numbered texts stay as they are."""
    keep = (F.length(text) < R.TRIM_MIN_CHARS) | is_numbered_read(F.col(text))
    df = collapse_runs(df, text, "__c")
    df = head_tail_cut(df, "__c", "__t", threshold, problem=problem)
    return df.withColumn(out, F.when(keep, F.col(text)).otherwise(F.col("__t"))).drop("__c", "__t")


# --- build noise --------------------------------------------------------------


def command_families(cmd: Column, rules=R.COMMAND_RULES) -> Column:
    """Names of the build families a command line belongs to."""
    parts = command_parts(cmd)
    matches = lambda pattern: F.exists(parts, lambda p: p.rlike(pattern))
    return F.array_compact(F.array(*[F.when(matches(c), name) for name, c, _, _ in rules]))


def _any(line: Column, families: Column, rules, which) -> Column:
    out = F.lit(False)
    for name, _, noise, sample in rules:
        patterns = noise if which == "noise" else ([sample] if sample else [])
        for p in patterns:
            out = out | (F.array_contains(families, name) & line.rlike(p))
    return out


def drop_command_noise(
    df: DataFrame, text: str = "text", families: str = "families", out: str = "quiet", rules=R.COMMAND_RULES, guard: str = R.NOISE_GUARD,
    min_chars: int = R.COMMAND_RULE_MIN_CHARS,
) -> DataFrame:
    """Replace progress lines of the command's families by counters; problems always stay.

    Adds ``out`` (the text, unchanged unless it clearly shrinks) and ``dropped``.
    """
    fam = F.col(families)
    active = (F.length(text) >= min_chars) & (F.size(fam) > 0)
    t = F.regexp_replace(F.regexp_replace(F.when(active, F.col(text)), R.ANSI, ""), r"\r(?!\n)", "\n")

    def classify(line):
        kind = (
            F.when(~line.rlike(r"\S"), "blank")
            .when(_any(line, fam, rules, "sample"), "sample")
            .when(_any(line, fam, rules, "noise") & ~line.rlike(guard), "noise")
            .otherwise("keep")
        )
        return F.struct(kind.alias("c"), line.alias("l"))

    df = df.withColumn("__all", F.transform(F.split(t, "\n"), classify))
    df = df.withColumns({"__k": F.filter("__all", lambda x: x["c"] != "sample"), "__n": F.filter("__all", lambda x: x["c"] == "noise")})
    df = df.withColumn("__sample", F.filter("__all", lambda x: x["c"] == "sample"))
    size = F.size("__k")
    pos = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    cls = lambda i: F.get(F.col("__k"), i)["c"]
    df = df.withColumn("__starts", F.filter(pos, lambda i: (i == 0) | (cls(i) == "keep") | (cls(i) != cls(i - 1))))

    def emit(start, i):
        run = F.coalesce(F.get(F.col("__starts"), i + 1), size) - start
        plural = F.when(run > 1, "s").otherwise("")
        note = F.concat(F.lit("  … "), run.cast("string"), F.lit(" progress line"), plural, F.lit(" omitted"))
        x = F.get(F.col("__k"), start)
        return F.when(x["c"] == "noise", note).when(x["c"] == "blank", "").otherwise(x["l"])

    body = F.array_join(F.transform("__starts", emit), "\n")
    n_sample = F.size("__sample")
    samples = F.array_join(F.transform(F.slice("__sample", 1, 3), lambda x: x["l"]), "\n")
    shown = F.least(n_sample, F.lit(3)).cast("string")
    notices = F.when(n_sample > 0, F.concat(F.lit("\n\n["), n_sample.cast("string"), F.lit(" notices; first "), shown, F.lit(":]\n"), samples)).otherwise("")
    body = F.regexp_replace(F.concat(F.regexp_replace(body, r"^\n+|\n+$", ""), notices), r"^\n+", "")
    dropped = F.size("__n") + n_sample
    worth = active & (dropped >= R.COMMAND_RULE_MIN_DROPPED) & (F.length(body) <= F.length(text) * R.COMMAND_RULE_MAX_SHARE)
    head = F.concat(
        F.lit("["), F.array_join(fam, "/"), F.lit(" output: "), dropped.cast("string"), F.lit(" progress/notice lines dropped, errors and warnings kept]\n"),
    )
    df = df.withColumns({"__body": body, "__worth": F.coalesce(worth, F.lit(False)), "__d": dropped, "__head": head})
    return df.withColumns(
        {
            out: F.when(F.col("__worth"), F.concat("__head", "__body")).otherwise(F.col(text)),
            "dropped": F.when(F.col("__worth"), F.col("__d")).otherwise(0).cast("bigint"),
        }
    ).drop("__all", "__k", "__n", "__sample", "__starts", "__body", "__worth", "__d", "__head")


# --- tests --------------------------------------------------------------------


def test_runner(text: Column, runners=R.TEST_RUNNERS) -> Column:
    chain = None
    for name, p in runners:
        chain = F.when(text.rlike(p), name) if chain is None else chain.when(text.rlike(p), name)
    return chain


def test_lines(
    df: DataFrame, key: str, text: str = "text", runners=R.TEST_RUNNERS, passed: str = R.TEST_PASS_LINE, failed: str = R.TEST_FAIL_LINE,
    summary: str = R.TEST_SUMMARY_LINE, header: str = R.TEST_SUMMARY_HEADER, min_chars: int = R.TEST_MIN_CHARS,
) -> DataFrame:
    """Lines of recognised test output with ``keep``: banner, summary lines and failure blocks.

    A failure keeps up to 40 lines until a passing line, a rule or two blank
    lines, and the indented lines before it up to its header.
    """
    src = df.filter(F.length(text) >= min_chars)
    clean = F.regexp_replace(F.regexp_replace(F.col(text), R.ANSI, ""), r"\r(?!\n)", "\n")
    src = src.select(key, clean.alias("__t")).withColumn("framework", test_runner(F.col("__t"), runners)).filter("framework is not null")
    src = src.select(key, "framework", F.length("__t").alias("text_chars"), F.split("__t", "\n").alias("__l"))
    src = src.withColumn("n_lines", F.size("__l")).select(key, "framework", "text_chars", "n_lines", F.posexplode("__l").alias("pos", "line"))
    line, pos = F.col("line"), F.col("pos")
    is_pass, blank = line.rlike(passed), ~line.rlike(r"\S")
    w = W.partitionBy(key).orderBy("pos")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    src = src.withColumns(
        {
            "is_pass": is_pass,
            "is_fail": line.rlike(failed) & ~is_pass,
            "is_header": line.rlike("^=== RUN"),
            "walks": line.rlike(r"^\s+\S") & ~is_pass,
            "hard": is_pass | line.rlike(R.BLOCK_SEPARATOR),
            "soft": blank & (F.coalesce(F.lead(~blank).over(w), F.lit(False)) == F.lit(False)),
            "frame": line.rlike(r"^\s+at .*(node_modules|node:internal)"),
            "is_summary": line.rlike(summary) & ((pos >= F.col("n_lines") - R.TEST_TAIL_LINES) | line.rlike(header)),
            "banner": (pos < 3) & ~blank,
        }
    )
    at = lambda flag: F.when(F.col(flag), F.col("pos"))
    src = src.withColumns(
        {
            "f": F.last(at("is_fail"), True).over(back),
            "b_hard": F.last(at("hard"), True).over(back),
            "b_soft": F.last(at("soft"), True).over(back),
            "no_frame": F.coalesce(F.last(F.when(~F.col("frame"), F.col("pos")), True).over(back), F.lit(-1)),
            "next_f": F.first(at("is_fail"), True).over(ahead),
            "next_stop": F.first(F.when(~F.col("walks"), F.col("pos")), True).over(ahead),
            "passes": F.sum(F.col("is_pass").cast("bigint")).over(back),
        }
    )
    f = F.col("f")
    none = F.lit(-1)
    # a run of vendored frames keeps every other line once it is past the first three lines of the block
    offset = F.col("pos") - F.greatest(F.col("no_frame") + 1, f + 2)
    noise_frame = F.col("frame") & (F.col("pos") > f + 2) & (offset % 2 == 1)
    inside = (
        f.isNotNull() & (F.col("pos") - f < R.TEST_BLOCK_LINES) & (F.coalesce("b_hard", none) <= f) & (F.coalesce("b_soft", none) <= f + 1) & ~noise_frame
    )
    walked = (
        F.col("next_f").isNotNull()
        & (F.col("next_f") - F.col("pos") <= R.TEST_BACK_LINES)
        & (F.col("walks") | F.col("is_header"))
        & (F.coalesce("next_stop", F.col("n_lines")) >= F.col("next_f"))
    )
    keep = F.coalesce(inside, F.lit(False)) | F.coalesce(walked, F.lit(False)) | F.col("is_summary") | F.col("banner")
    return src.withColumn("keep", keep).select(key, "framework", "text_chars", "n_lines", "pos", "line", "is_pass", "is_fail", "passes", "keep")


def test_summary(lines: DataFrame, key: str, max_chars: int | None = None) -> DataFrame:
    """Kept lines joined with counters for what was left out, one row per recognised text.

    All kept lines are shown unless ``max_chars`` is given: then a longer body keeps five sevenths of it from the
    start and three fourteenths from the end, ``hidden_chars`` says how much lies between, and so does the text.
    """
    w = W.partitionBy(key).orderBy("pos")
    kept = lines.filter("keep")
    prev = F.lag(F.struct("pos", "passes")).over(w)
    kept = kept.withColumn("prev", prev)
    gap = F.col("pos") - F.col("prev.pos") - 1
    inner = F.col("passes") - F.col("is_pass").cast("bigint") - F.col("prev.passes")
    passing = F.when(inner > 0, F.concat(F.lit(" ("), inner.cast("string"), F.lit(" passing)"))).otherwise("")
    note = F.when(gap > 0, F.concat(F.lit("  … "), gap.cast("string"), F.lit(" line(s) omitted"), passing, F.lit("\n"))).otherwise("")
    kept = kept.withColumn("part", F.concat(F.coalesce(note, F.lit("")), "line"))
    # bounded by one text's lines
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n")
    out = kept.groupBy(key).agg(
        F.first("framework").alias("framework"),
        F.first("text_chars").alias("text_chars"),
        F.first("n_lines").alias("n_lines"),
        F.count("*").alias("kept_lines"),
        F.count_if("is_fail").alias("failures"),
        F.max("pos").alias("last_pos"),
        body.alias("body"),
    )
    rest = F.col("n_lines") - 1 - F.col("last_pos")
    body = F.when(rest > 0, F.concat("body", F.lit("\n  … "), rest.cast("string"), F.lit(" line(s) omitted"))).otherwise(F.col("body"))
    out = out.withColumns({"body": body}).withColumn("hidden_chars", F.lit(0).cast("bigint"))
    if max_chars is not None:
        first, last = max_chars * 5 // 7, max_chars * 3 // 14
        cut = F.length("body") > max_chars
        hidden = F.when(cut, F.length("body") - (first + last)).otherwise(0).cast("bigint")
        long = F.concat(F.substring("body", 1, first), F.lit("\n  … "), F.col("hidden_chars").cast("string"), F.lit(" character(s) hidden\n"), F.right("body", F.lit(last)))
        out = out.withColumn("hidden_chars", hidden).withColumn("body", F.when(F.col("hidden_chars") > 0, long).otherwise(F.col("body")))
    head = F.concat(
        F.lit("["), "framework", F.lit(" output: "), F.col("failures").cast("string"), F.lit(" failing line(s); "), (F.col("n_lines") - F.col("kept_lines")).cast("string"),
        F.lit(" other line(s) left out]\n"),
    )
    # an exact product: a body of just the share still counts
    worth = F.length("body") <= F.col("text_chars") * F.lit(Decimal(str(R.TEST_MAX_SHARE)))
    return out.select(
        key, "framework", worth.alias("changed"), "failures", "kept_lines", F.col("n_lines").cast("bigint").alias("total_lines"), "hidden_chars",
        F.when(worth, F.concat(head, "body")).alias("summary"),
    )


def compiler_errors(lines: DataFrame, key: str, top: int = 15, min_errors: int = R.COMPILER_MIN_ERRORS) -> DataFrame:
    """Errors per file for outputs above the limit; ``lines``: key, pos, line."""
    err = lines.withColumn("file", F.regexp_extract("line", R.COMPILER_ERROR, 1)).filter(F.col("file") != "")
    per = err.groupBy(key, "file").agg(F.count("*").alias("n"))
    total = per.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("files")).filter(F.col("total") > min_errors)
    w = W.partitionBy(key).orderBy(F.col("n").desc(), "file")
    ranked = per.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(total, key).withColumn("more_files", F.greatest(F.lit(0), F.col("files") - top).cast("bigint")).drop("files")


def shown_errors(lines: DataFrame, key: str, n: int = 30) -> DataFrame:
    """The first ``n`` error lines of each output."""
    err = lines.filter(F.regexp_extract("line", R.COMPILER_ERROR, 1) != "")
    w = W.partitionBy(key).orderBy("pos")
    return err.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


# --- JSON lists ---------------------------------------------------------------


def _is_nested(v: Column) -> Column:
    return v.rlike(r"^\s*[\[{]")


def json_list(df: DataFrame, text: str = "text", min_chars: int = R.JSON_MIN_CHARS) -> DataFrame:
    """Add ``items``: the raw elements of the main array (the root or the largest one level down)."""
    t = F.when((F.length(F.trim(text)) >= min_chars) & F.trim(text).rlike(r"^[\[{]"), F.trim(text))
    root = F.from_json(F.when(t.startswith("["), t), "array<string>")
    fields = F.map_values(F.from_json(F.when(t.startswith("{"), t), "map<string,string>"))
    lists = F.transform(F.filter(fields, lambda v: v.startswith("[")), lambda v: F.from_json(v, "array<string>"))
    # the first of the longest lists wins, as in reading order
    best = F.aggregate(lists, F.array().cast("array<string>"), lambda acc, x: F.when(F.size(x) > F.size(acc), x).otherwise(acc))
    return df.withColumn("items", F.coalesce(root, F.when(t.startswith("{"), best)))


def json_compact(df: DataFrame, text: str = "text", min_chars: int = R.JSON_MIN_CHARS, identity=R.JSON_IDENTITY) -> DataFrame:
    """First items in full without empty fields, the rest as one identity line each."""
    df = json_list(df, text, min_chars)
    n = F.size("items")
    objects = F.size(F.filter("items", lambda x: x.startswith("{")))
    df = df.filter(F.col("items").isNotNull() & (n >= R.JSON_MIN_ITEMS) & (objects >= n * R.JSON_OBJECT_SHARE))
    # each element is parsed once; both renderings work on the parsed maps
    parse = lambda x: F.struct(x.alias("raw"), F.from_json(x, "map<string,string>").alias("m"))
    df = df.withColumn("parsed", F.transform(F.slice("items", 1, R.JSON_FULL_ITEMS + R.JSON_LINES), parse))

    def clean(x):
        kept = F.map_filter(
            x["m"],
            lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}") & ~(k.endswith("_url") & ~k.isin(R.JSON_KEPT_URLS) & ~_is_nested(v)),
        )
        return F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")

    def line(x):
        value = lambda k: F.try_element_at(x["m"], k)
        keys = F.filter(F.array(*[F.lit(k) for k in identity]), lambda k: value(k).isNotNull() & ~_is_nested(value(k)))
        picked = F.transform(F.slice(keys, 1, 5), lambda k: F.concat(k, F.lit("="), F.substring(value(k), 1, 80)))
        first = F.transform(
            F.filter(F.slice(F.map_entries(x["m"]), 1, 4), lambda e: ~_is_nested(F.coalesce(e["value"], F.lit("[")))),
            lambda e: F.concat(e["key"], F.lit("="), F.substring(e["value"], 1, 60)),
        )
        words = F.when(F.size(picked) > 0, picked).otherwise(first)
        return F.concat(F.lit("  "), F.when(x["raw"].startswith("{"), F.array_join(words, " ")).otherwise(F.substring(x["raw"], 1, 160)))

    rest = n - R.JSON_FULL_ITEMS
    head = F.array_join(F.transform(F.slice("parsed", 1, R.JSON_FULL_ITEMS), clean), "\n")
    listed = F.array_join(F.transform(F.slice("parsed", R.JSON_FULL_ITEMS + 1, R.JSON_LINES), line), "\n")
    more = F.when(rest > R.JSON_LINES, F.concat(F.lit("\n  … and "), (rest - R.JSON_LINES).cast("string"), F.lit(" more"))).otherwise("")
    df = df.withColumns({"head": head, "listed": F.concat(listed, more), "n_items": n.cast("bigint")})
    size = F.length("head") + F.length("listed")
    return df.withColumn("changed", size <= F.length(text) * R.JSON_MAX_SHARE).drop("items", "parsed")


# --- the chain ----------------------------------------------------------------


def compaction_chain(df: DataFrame, key: str, command: str = "command", text: str = "text") -> DataFrame:
    """Rules, tests, JSON, then trim; the first step that changed the text names the kind.

    Adds ``short`` and reports kind, removed_chars and saved_tokens where at least 200 characters went.
    The noise step's and the last step's results are tables in the shared folder: filters on them would
    otherwise be rewritten over nested expressions, each level copying the one below, and not plan in minutes.
    """
    df = df.withColumn("__fam", command_families(F.col(command)))
    df = written(drop_command_noise(df, text, "__fam", "__a").drop("dropped"), "quiet-output")
    tests = test_summary(test_lines(df, key, "__a"), key).filter("changed").select(key, F.col("summary").alias("__sum"))
    df = df.join(tests, key, "left").withColumn("__b", F.coalesce("__sum", "__a"))
    packed = json_compact(df.select(key, "__b"), "__b").filter("changed")
    packed = packed.select(key, F.concat(F.lit("["), F.col("n_items").cast("string"), F.lit(" items]\n"), "head", F.lit("\n"), "listed").alias("__json"))
    df = df.join(packed, key, "left").withColumn("__c2", F.coalesce("__json", "__b"))
    threshold = F.when(wants_content(F.col(command)), R.TRIM_CONTENT_CHARS).otherwise(R.TRIM_THRESHOLD_CHARS)
    df = trim_output(df, "__c2", "short", threshold)
    kind = (
        F.when(F.col("__sum").isNotNull(), "testsum")
        .when(F.col("__a") != F.col(text), "cmdrules")
        .when(F.col("__json").isNotNull(), "json")
        .when(F.col("short") != F.col("__c2"), "trim")
    )
    removed = F.length(text) - F.length("short")
    df = df.withColumns({"kind": kind, "removed_chars": removed.cast("bigint")}).drop("__fam", "__a", "__sum", "__b", "__json", "__c2")
    df = written(df, "short-output").filter(F.col("kind").isNotNull() & (F.col("removed_chars") >= R.MIN_REMOVED_CHARS))
    return df.withColumn("saved_tokens", removed_tokens(F.col("removed_chars")))


# --- prose --------------------------------------------------------------------


def strip_filler(text: Column) -> Column:
    """Politeness filler removed outside code, URLs, quotes and paths."""
    plain, kept = F.split(text, R.PROTECTED_SPAN), F.regexp_extract_all(text, F.lit(R.PROTECTED_SPAN), F.lit(0))

    def shorten(s):
        for p, to in R.FILLER_REPLACEMENTS:
            s = F.regexp_replace(s, p, to)
        for p in R.FILLERS:
            s = F.regexp_replace(s, p, "")
        s = F.regexp_replace(F.regexp_replace(s, r"[ \t]{2,}", " "), r" +([,.!?;:])", "$1")
        return F.regexp_replace(s, r"\n{3,}", "\n\n")

    spans = F.zip_with(plain, kept, lambda a, b: F.concat(shorten(F.coalesce(a, F.lit(""))), F.coalesce(b, F.lit(""))))
    return F.trim(F.array_join(spans, ""))


def filler_report(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Tokens before and after filler removal per source."""
    # the stripped text is its own column first, so the estimate does not repeat the work
    df = df.select(by, text, strip_filler(F.col(text)).alias("__short"))
    out = df.select(by, token_estimate(F.col(text)).alias("b"), token_estimate(F.col("__short")).alias("a")).groupBy(by).agg(
        F.count("*").alias("texts"), F.sum("b").alias("tokens_before"), F.sum("a").alias("tokens_after")
    )
    share = F.coalesce(F.try_divide(F.col("tokens_before") - F.col("tokens_after"), F.col("tokens_before")), F.lit(0.0))
    return out.withColumn("saved_pct", F.round(share * 100, 6))


def failure_excerpt(df: DataFrame, text: str = "text", failing: str = R.FAILURE_LINE, max_chars: int = R.FAILURE_MAX_CHARS) -> DataFrame:
    """Add ``excerpt`` (what is wrong, with the indented line after it, shortened in the middle) and its fingerprint ``fp``.

    The fingerprint is that of all these lines, however many are shown; without any it is that of all lines that
    are not blank, of which the last 25 are shown.
    """
    t = F.regexp_replace(F.regexp_replace(F.col(text), R.ANSI, ""), r"\r(?!\n)", "\n")
    df = df.withColumn("__l", F.split(t, "\n"))
    hit = F.filter("__l", lambda s, i: s.rlike(failing) | ((i > 0) & s.rlike(r"^\s+\S") & F.coalesce(F.get(F.col("__l"), i - 1).rlike(failing), F.lit(False))))
    df = df.withColumn("__hit", hit)
    solid = F.filter("__l", lambda s: s.rlike(r"\S"))
    tail = F.slice(solid, F.greatest(F.lit(1), F.size(solid) - 24), F.lit(25))
    wrong = F.transform("__hit", lambda s: F.rtrim(s))
    joined = lambda rest: F.array_join(F.array_distinct(F.when(F.size("__hit") > 0, wrong).otherwise(rest)), "\n")
    df = df.withColumns({"__e": joined(tail), "__a": joined(solid)})
    long = F.concat(F.substring("__e", 1, int(max_chars * 0.6)), F.lit("\n…\n"), F.expr(f"right(__e, {int(max_chars * 0.35)})"))
    df = df.withColumn("excerpt", F.when(F.length("__e") > max_chars, long).otherwise(F.col("__e")))
    same = F.regexp_replace(F.regexp_replace("__a", r"\d+(\.\d+)?\s*(ms|s)\b", ""), r"\d+", "#")
    return df.withColumn("fp", F.substring(F.sha1(same), 1, 12)).drop("__l", "__hit", "__e", "__a")


def failure_clusters(df: DataFrame, key: str, **kw) -> DataFrame:
    """Outputs that fail the same way."""
    return failure_excerpt(df, **kw).groupBy("fp").agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.min_by("excerpt", key).alias("excerpt"))


def plain_prose(text: Column) -> Column:
    """Code blocks, markdown marks and line breaks gone, list items kept."""
    t = F.regexp_replace(text, r"(?s)```.*?```", " [code] ")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s+", "")
    t = F.regexp_replace(t, r"\*\*|__", "")
    t = F.regexp_replace(t, r"(?m)^\s*(?:[-*•]|\d+[.)])\s+", "· ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sentences_of(text: Column) -> Column:
    return F.filter(F.split(text, R.SENTENCE_BREAK), lambda s: s != "")


def _fit(lengths: Column, budget) -> Column:
    """How many leading items fit, stopping at the first that does not."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(acc, x):
        total = acc["sum"] + x + 1
        stop = acc["stop"] | (total > budget)
        return F.struct(F.when(stop, acc["sum"]).otherwise(total).alias("sum"), F.when(stop, acc["n"]).otherwise(acc["n"] + 1).alias("n"), stop.alias("stop"))

    return F.aggregate(lengths, start, step, lambda acc: acc["n"])


def cut_words(x: Column, n: int, from_end: bool = False) -> Column:
    """About ``n`` characters of ``x`` cut at a word, with an ellipsis on the cut side."""
    if from_end:
        y = F.right(x, F.lit(n))
        sp = F.locate(" ", y) - 1
        z = F.when((sp >= 0) & (sp < n * 0.5), slice_text(y, sp + 1)).otherwise(y)
        cut = F.concat(F.lit("…"), z)
    else:
        y = F.substring(x, 1, n)
        sp = n - F.locate(" ", F.reverse(y))
        sp = F.when(F.locate(" ", F.reverse(y)) > 0, sp).otherwise(-1)
        cut = F.concat(F.when(sp > n * 0.5, F.substring(y, F.lit(1), sp)).otherwise(y), F.lit("…"))
    return F.when(F.length(x) <= n, x).otherwise(cut)


def squeeze_text(df: DataFrame, n: int, text: str = "text", out: str = "squeezed") -> DataFrame:
    """Whole sentences from the start and the end within ``n`` characters, a gap mark between."""
    hb = int(n * 0.55)
    tb = n - hb - 5
    df = df.withColumn("__p", plain_prose(F.col(text))).withColumn("__s", sentences_of(F.col("__p")))
    df = df.withColumn("__h", _fit(F.transform("__s", lambda s: F.length(s)), hb))
    rest = F.slice("__s", F.col("__h") + 1, F.greatest(F.lit(0), F.size("__s") - F.col("__h")))
    df = df.withColumn("__r", F.reverse(rest))
    df = df.withColumn("__t", _fit(F.transform("__r", lambda s: F.length(s)), tb))
    first, last = F.get("__s", F.lit(0)), F.try_element_at("__s", F.lit(-1))
    head = F.when(F.col("__h") > 0, F.array_join(F.slice("__s", F.lit(1), F.col("__h")), " ")).otherwise(cut_words(first, hb))
    tail = F.when(F.col("__t") > 0, F.array_join(F.reverse(F.slice("__r", F.lit(1), F.col("__t"))), " ")).otherwise(cut_words(last, tb, True))
    inside = (F.col("__h") == 0) | (F.col("__t") == 0)
    used = F.greatest(F.col("__h"), F.lit(1)) + F.greatest(F.col("__t"), F.lit(1))
    gap = F.when(inside | (F.size("__s") - used > 0), " […] ").otherwise(" ")
    return df.withColumn(out, F.when(F.length("__p") <= n, F.col("__p")).otherwise(F.concat(head, gap, tail))).drop("__p", "__s", "__h", "__r", "__t")


def grep_lines(df: DataFrame, key: str, pattern: str, text: str = "text", cap: int = 100) -> DataFrame:
    """Case-insensitive matching lines in reading order, at most ``cap``, with how many more there were."""
    hit = lambda s: s.rlike("(?i)" + pattern)
    numbered = F.transform(F.split(text, "\n"), lambda s, i: F.struct((i + 1).cast("bigint").alias("line_no"), s.alias("line")))
    found = F.filter(numbered, lambda x: hit(x["line"]))
    # (?m): an anchor in the pattern holds for lines here too
    matched = df.filter(F.col(text).rlike("(?im)" + pattern)).select(key, found.alias("found"))
    total = matched.agg(F.sum(F.size("found"))).scalar()
    rows = matched.select(key, F.inline("found")).orderBy(key, "line_no").limit(cap)
    return rows.withColumn("more", F.greatest(F.lit(0), total - cap).cast("bigint"))


def read_lines(df: DataFrame, key: str, start: int, end: int, text: str = "text", cap: int | None = None) -> DataFrame:
    """Lines start..end (1-based, inclusive) of every text, of each at most ``cap`` if one is given."""
    n = end - start + 1 if cap is None else min(end - start + 1, cap)
    part = F.slice(F.split(text, "\n"), start, n)
    return df.select(key, F.posexplode(part).alias("i", "line")).select(key, (F.col("i") + start).cast("bigint").alias("line_no"), "line")
