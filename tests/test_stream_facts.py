"""Facts captured from blocks that arrive in parts, against the batch operator applied to each part."""

from pyspark.sql import functions as F

from tracewell.operators.facts import extract_facts
from tracewell.session import work_path
from tracewell.streaming import facts, jobs

SCHEMA = "session_id string, seq long, block int, type string, block_type string, text string, tool string, tool_id string, command string, result_id string, is_error boolean, result string"


def said(s, seq, text, who="assistant"):
    return (s, seq, 0, who, "text", text, None, None, None, None, None, None)


def ran(s, seq, command, failed):
    """A call and the result in the next entry."""
    return [(s, seq, 1, "assistant", "tool_use", None, "Bash", f"t{seq}", command, None, None, None), (s, seq + 1, 0, "user", "tool_result", None, None, None, None, f"t{seq}", failed, "out " * 5)]


PARTS = [
    [said("a", 0, "Always use tabs in this repository please", "user"), *ran("a", 1, "npm test", True), said("a", 3, "The bug was a missing semicolon in the parser file"), said("b", 0, "We decided to keep the old parser for now")],
    [*ran("a", 10, "npm test", False), said("a", 12, "We decided to keep the old parser for now"), said("a", 13, "Always use tabs in this repository please", "user"), said("c", 0, None)],
    [said("a", 20, "We decided to drop support for the ancient interpreter"), said("b", 1, "x" * 500), ("a", 21, 0, "assistant", None, None, None, None, None, None, None, None)],
]


def runs(spark, parts, **kw):
    folder, checkpoint, sink = (work_path(spark, x) for x in ("facts-in", "facts-state", "facts-sink"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        out = facts.capture_facts(jobs.arriving(spark, folder, spark.createDataFrame([], SCHEMA).schema), checkpoint, sink, **kw)
    return {(r.session_id, r.nth): (r.kind, r.text) for r in out.collect()}, out


def test_parts(spark):
    got, _ = runs(spark, PARTS, due_chars=1)
    a = [v for k, v in sorted(got.items()) if k[0] == "a"]
    # a command that failed in an earlier part counts as mended; what is known is not found again
    assert a == [
        ("preference", "User preference: Always use tabs in this repository please"), ("cause", "Root cause: The bug was a missing semicolon in the parser file"),
        ("decision", "We decided to keep the old parser for now"), ("command", "Command that works here: `npm test`"), ("decision", "We decided to drop support for the ancient interpreter"),
    ]
    assert [v for k, v in sorted(got.items()) if k[0] == "b"] == [("decision", "We decided to keep the old parser for now")]


def test_waiting_and_room(spark):
    # b is due only with the long text of the last part, and its first text is searched then
    got, _ = runs(spark, PARTS, due_chars=400)
    assert got == {("b", 1): ("decision", "We decided to keep the old parser for now")}
    few, _ = runs(spark, PARTS, due_chars=1, most=2)
    assert sorted(k for k in few if k[0] == "a") == [("a", 1), ("a", 2)]


def test_one_part_is_the_batch_operator(spark):
    rows = [r for p in PARTS for r in p]
    got, _ = runs(spark, [rows], due_chars=1)
    want = extract_facts(spark.createDataFrame(rows, SCHEMA)).select("session_id", F.col("rank").cast("long"), "kind", "text").collect()
    assert got == {(r.session_id, r["rank"]): (r.kind, r.text) for r in want}
