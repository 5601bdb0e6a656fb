"""Summaries, excerpts and examples of whole texts."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracewell.operators import behaviour as H
from tracewell.operators import compaction as K


def summary(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    lines = K.test_lines(df, "id", runners=[("r", "^RUN")], passed="^ok", failed="^not ok", summary="^end", header="^RUN", min_chars=10)
    return K.test_summary(lines, "id", **kw).first()


def test_every_failing_line_of_a_long_body_is_kept(spark):
    fails = [f"not ok {i} " + "x" * 200 for i in range(300)]
    text = "\n".join(["RUN", *["ok " + "y" * 60 for _ in range(2000)], *fails, "end"])
    row = summary(spark, text)
    assert row.failures == 300 and row.changed and row.hidden_chars == 0 and all(f in row.summary for f in fails)
    assert row.summary.startswith("[r output: 300 failing line(s); ")
    cut = summary(spark, text, max_chars=14_000)
    body = row.summary.split("\n", 1)[1]
    assert cut.hidden_chars == len(body) - 13_000 and f"{cut.hidden_chars} character(s) hidden" in cut.summary and cut.summary.endswith(body[-3000:])


def test_fingerprint_sees_what_the_excerpt_hides(spark):
    same = ["error: " + "a" * 100] + [f"error: {c}" + "b" * 100 for c in "cdefghijklmnopqrstuvwxyz"]
    other = same[:15] + ["error: something else"] + same[16:]
    quiet = [f"line {'x' * (i + 1)}" for i in range(60)]
    texts = ["\n".join(t) for t in (same, other, same, quiet, ["another start", *quiet[1:]])] + ["error 12 in 3ms", "error 7 in 90 s", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r.id: r for r in K.failure_excerpt(df, failing="^error").collect()}
    assert rows[0].excerpt == rows[1].excerpt and "…" in rows[0].excerpt and rows[0].fp != rows[1].fp and rows[0].fp == rows[2].fp
    assert rows[3].excerpt == rows[4].excerpt and rows[3].fp != rows[4].fp
    assert rows[5].fp == rows[6].fp and rows[7].excerpt == ""


def test_numbered_reads_with_long_lines(spark):
    rows = [("     1\t" + "x" * 900 + "\n     2\ty\n     3\tz", True), ("     1\t" + "x" * 900 + "\nplain\nplain", False), ("1→a", True), ("a\n1→b\n2→c\n3→d\n4→e", True)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", K.is_numbered_read(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_examples_and_evidence_are_whole(spark):
    command = "pytest " + "-k name " * 40 + "tests"
    pairs = spark.createDataFrame([("pytest", command, 400, False, 1, 1)], "key string, command string, chars long, shortened boolean, us long, call_id long")
    assert H.output_by_command(pairs).first().example == command and H.output_by_command(pairs, example_chars=100).first().example == command[:100]
    line = "1 failed " + "z" * 400
    calls = spark.createDataFrame([(1, 1, 5, "pytest")], "session_id long, call_id long, us long, command string")
    results = spark.createDataFrame([(1, 1, f"start\n{line}\n", False)], "session_id long, call_id long, text string, is_error boolean")
    got = H.last_check(calls, results, calls.where("false")).first()
    assert got.line == line and got.verdict == "FAILED"
    assert H.last_check(calls, results, calls.where("false"), line_chars=150).first().line == line[:150]


def test_only_texts_of_last_checks_meet_a_result(spark):
    calls = spark.createDataFrame([(1, i, i, "pytest") for i in range(50)] + [(2, 99, 99, "ls")], "session_id long, call_id long, us long, command string")
    named = calls.select("session_id", "call_id", F.lit(False).alias("is_error"), (F.col("call_id") % 7).alias("doc_id"))
    texts = spark.range(7).select(F.col("id").alias("doc_id"), F.concat(F.lit("1 passed in "), "id").alias("text"))
    got = H.last_check(calls, named, calls.where("false"), texts=texts).collect()
    assert [(r.session_id, r.call_id, r.line) for r in got] == [(1, 49, "1 passed in 0")]
    whole = H.last_check(calls, named.join(texts, "doc_id"), calls.where("false")).collect()
    assert [r.asDict() for r in whole] == [r.asDict() for r in got]
    # of the query's plan, nothing but the written last checks is joined with texts
    plan = entry.queries()["last_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"event_id#\d+L? %", plan)
