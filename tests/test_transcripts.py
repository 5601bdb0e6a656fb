"""Transcript files as a client leaves them: torn, blank and foreign lines, subagents, contents of both shapes; jobs that are started again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell.plans import streams
from tracewell.plans import transcripts as plans
from tracewell.sources import transcripts as T
from tracewell.streaming import jobs, stateful


def line(role, content, **more):
    return json.dumps({"type": role, "timestamp": "2024-05-01T10:00:00Z", "message": {"id": more.pop("id", "m"), "role": role, "content": content, **more.pop("message", {})}, **more})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "p" / "s1" / "subagents").mkdir(parents=True)
    usage = {"model": "x", "usage": {"input_tokens": 3, "cache_creation": {"ephemeral_1h_input_tokens": 5}}}
    call = [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "I will look at it"}, None, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls -la /tmp"}}, {"type": "tool_use", "id": "t2", "name": "Noop"}]
    result = [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "first line here"}, {"type": "image"}, {"type": "text", "text": "second"}]}, {"type": "tool_result", "tool_use_id": "t2", "content": "a plain result text"}]
    main = [line("user", "please <private>secret</private> fix it"), "", line("assistant", call, message=usage), line("user", result), "log: hello", "[1, 2]", line("user", "<system-reminder> nothing to see"), line("user", "meta text that is long", isMeta=True), line("user", "short"), "  ", line("assistant", "half")[:25]]
    (root / "p" / "s1.jsonl").write_text("\n".join(main) + "\n")
    (root / "p" / "s1" / "subagents" / "a.jsonl").write_text(line("assistant", "sidechain text that is long", isSidechain=True) + "\n")
    (root / "p" / "s2.jsonl").write_text("")
    (root / "p" / "other.txt").write_text(line("user", "not a transcript"))
    return root


def test_lines_and_sessions(spark, folder):
    entries, rejects = T.read_transcripts(spark, str(folder))
    assert sorted((r.session_id, r.is_subagent, r.type) for r in entries.collect()) == [("s1", False, "assistant")] + [("s1", False, "user")] * 5 + [("s1", True, "assistant")]
    assert sorted((r.session_id, r.line_kind) for r in rejects.collect()) == [("s1", "blank")] * 2 + [("s1", "other")] * 2 + [("s1", "torn")]
    used = entries.where("input_tokens IS NOT NULL").collect()
    assert [(r.model, r.input_tokens, r.cache_1h, r.output_tokens) for r in used] == [("x", 3, 5, None)]


def test_recent_files(spark, folder):
    os.utime(folder / "p" / "s1.jsonl", (1_600_000_000, 1_600_000_000))
    entries, _ = T.read_transcripts(spark, str(folder), modified_after="2021-01-01T00:00:00")
    assert [r.is_subagent for r in entries.collect()] == [True]


def test_blocks_and_items(spark, folder):
    entries, _ = T.read_transcripts(spark, str(folder))
    blocks = T.explode_blocks(entries)
    calls = {r.tool_id: (r.block, r.tool, r.input) for r in blocks.where("block_type = 'tool_use'").collect()}
    assert calls == {"t1": (3, "Bash", '{"command":"ls -la /tmp"}'), "t2": (4, "Noop", "{}")}
    results = {r.result_id: (r.result, r.is_error) for r in blocks.where("block_type = 'tool_result'").collect()}
    assert results == {"t1": ("first line here\nsecond", True), "t2": ("a plain result text", False)}
    assert [r.thinking for r in blocks.where("thinking IS NOT NULL").collect()] == ["hm"]
    items = {(r.who, r.item) for r in T.to_history_items(blocks).collect()}
    assert items == {("you", "please [private] fix it"), ("Claude", "I will look at it"), ("Claude → Bash", '{"command":"ls -la /tmp"}'), ("tool result", "first line here\nsecond"), ("tool result", "a plain result text")}
    cut = {(r.who, r.item) for r in T.to_history_items(blocks, max_text=6, max_tool=5).collect()}
    assert ("you", "please") in cut and ("tool result", "first") in cut


def test_buffer(spark, tmp_path):
    (tmp_path / "s9.jsonl").write_text('{"t":"cmd","ts":"2024-05-01T10:00:00Z","cmd":"ls","extra":1}\n\n{"t":"read","keys":["a"]}\n{"t":"fi\n{"x":1}\n')
    events, torn = T.read_buffer(spark, str(tmp_path))
    assert sorted((r.session_id, r.t, r.cmd, r["keys"]) for r in events.collect()) == [("s9", "cmd", "ls", None), ("s9", "read", None, ["a"])]
    assert [r.session_id for r in torn.collect()] == ["s9"]


def test_ingest_goes_on_after_a_restart(spark, folder, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    how = (str(landing), str(tmp_path / "state"), str(tmp_path / "sink"))
    (landing / "a.jsonl").write_text(line("user", "one", id="1") + "\n" + line("user", "two", id="2")[:30] + "\n")
    assert sorted(r.msg_id for r in jobs.ingest_transcripts(spark, *how).collect()) == ["1"]
    (landing / "b.jsonl").write_text(line("user", "two", id="2") + "\n\n" + line("user", "three", id="3") + "\n")
    assert sorted(r.msg_id for r in jobs.ingest_transcripts(spark, *how).collect()) == ["1", "2", "3"]
    assert sorted(r.msg_id for r in jobs.ingest_transcripts(spark, *how).collect()) == ["1", "2", "3"]
    assert [r.line_kind for r in spark.read.parquet(f"{how[2]}/rejected").orderBy("line_kind").collect()] == ["blank", "torn"]


def test_levels_once_over_three_runs(spark, tmp_path):
    """Levels 1, 2, 2 and, after a reset, 1 again; the state lives through restarts."""
    schema = "session_id long, ts timestamp, seq long, value long, is_boundary boolean"
    parts = [[(1, 100, False), (2, 250, False)], [(3, 210, False), (4, 50, False), (5, 900, False)], [(6, 0, True), (7, 120, False), (8, 130, False)]]
    got = []
    for part in parts:
        rows = [(s, None, seq, value, reset) for s in (1, 2) for seq, value, reset in part]
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("seq"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with stateful.keyed_state(spark):
            out = stateful.alert_levels(jobs.arriving(spark, f"{tmp_path}/in", df.schema), 100)
            got = jobs.run_available(out, "levels", f"{tmp_path}/state", f"{tmp_path}/out").collect()
    assert sorted((r.session_id, r.seq, r.level, r["items"], r.total) for r in got) == [(s, *x) for s in (1, 2) for x in [(1, 1, 1, 100), (2, 2, 2, 350), (5, 4, 5, 1510), (7, 1, 1, 120)]]


def test_first_arrivals_over_two_runs(spark, tmp_path):
    """A row that comes again in a later run is dropped as long as the watermark has not passed it."""
    for ids in ([1, 2, 2], [2, 3, 1]):
        df = spark.createDataFrame([(i, 100) for i in ids], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = jobs.first_arrivals(jobs.arriving(spark, f"{tmp_path}/in", df.schema), "ts", ["id"])
        got = jobs.run_available(out, "first", f"{tmp_path}/state", f"{tmp_path}/out")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]


def test_late_rows_are_kept_apart(spark, tmp_path):
    for seconds in ([1000, 5000], [4500, 4000, 9000, None], [8000, 8500]):
        df = spark.createDataFrame([(s,) for s in seconds], "s long").select("s", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        on_time, late = jobs.split_late(jobs.arriving(spark, f"{tmp_path}/in", df.schema), "ts", f"{tmp_path}/state", f"{tmp_path}/out")
    assert sorted(r.s for r in late.collect()) == [4000, 8000]  # behind 5000 and 9000 by more than ten minutes
    assert sorted((r.s is None, r.s) for r in on_time.collect()) == [(False, 1000), (False, 4500), (False, 5000), (False, 8500), (False, 9000), (True, None)]


def test_levels_where_a_mark_is_missing(spark, tmp_path):
    """A row whose reset mark is null resets nothing."""
    df = spark.createDataFrame([(1, 1, 100, False), (1, 2, 90, None), (1, 3, 400, None)], "session_id long, seq long, value long, is_boundary boolean").withColumn("ts", F.timestamp_seconds("seq"))
    df.write.parquet(f"{tmp_path}/in")
    with stateful.keyed_state(spark):
        got = jobs.run_available(stateful.alert_levels(jobs.arriving(spark, f"{tmp_path}/in", df.schema), 100), "levels").collect()
    assert sorted((r.seq, r.level, r["items"], r.total) for r in got) == [(1, 1, 1, 100), (3, 3, 3, 590)]


def test_watch_keeps_numbers_whole(spark, tmp_path):
    """A request without a count beside it does not turn the tokens of others into doubles."""
    big = 2**53 + 1
    shape = "conv long, us long, seq long, model string, tools array<string>, system string, msgs array<string>, cache_creation long, cache_1h long, cache_read long"
    rows = [(1, 1, 1, "a", ["t"], "s", ["m"], None, None, None), (1, 2, 2, "b", ["t"], "s", ["m"], big, None, 0), (1, 3, 3, "b", ["t"], "s", ["n"], big, 0, 0)]
    df = spark.createDataFrame(rows, shape)
    df.write.parquet(f"{tmp_path}/in")
    with stateful.keyed_state(spark):
        got = jobs.run_available(stateful.cache_watch(jobs.arriving(spark, f"{tmp_path}/in", df.schema)), "watch").collect()
    assert sorted((r.seq, r.culprit, r.tokens) for r in got) == [(2, "model-switch", big), (3, "history-edited", big)]


@pytest.mark.parametrize("n, accuracy", [(1, 10_000), (2, 10_000), (11, 10_000), (2000, 50)])
def test_thirds_are_exact_and_land_in_several_files(spark, monkeypatch, n, accuracy):
    """Places of equal and of different values as the exact percentile has them, rounded down to a row."""
    monkeypatch.setattr(streams, "ACCURACY", accuracy)
    df = spark.range(n).select((F.col("id") * 37 % 1009 % 700).alias("v")).repartition(4)
    rows = sorted(r.v for r in df.collect())
    assert streams.at_shares(df, "v", [1 / 3, 2 / 3]) == [rows[int(s * (n - 1))] for s in (1 / 3, 2 / 3)]
    folder, writes = streams.landed(spark, df, "v")
    writes[0]()
    first = spark.read.parquet(folder)
    assert sorted(r.v for r in first.collect()) == [v for v in rows if v <= rows[int((n - 1) / 3)]]
    assert n < 2000 or len(first.inputFiles()) > 1


def test_files_do_not_grow_with_sessions(spark, tmp_path):
    """Many sessions in few files, their lines as they were: torn, blank and foreign ones, line ends and quotes in texts."""
    rows = [(i, t, "user" if t % 2 else "assistant", None if i == 7 and t == 1 else f'say "{t}"\r\nof \t{i}') for i in range(120) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    entries, rejects = plans.transcripts(spark, str(tmp_path))
    assert len(entries.inputFiles()) <= 16
    got = {(r.session_id, r.msg_id, r.is_subagent) for r in entries.collect()}
    assert got == {(str(i), f"c-{i}-{t}", t == 4) for i, t, _, _ in rows}
    want = [(str(i), k) for i in range(120) for every, k in ((4, "torn"), (3, "blank"), (5, "other")) if i % every == 0]
    assert sorted((r.session_id, r.line_kind) for r in rejects.collect()) == sorted(want)
    said = {r.text for r in T.explode_blocks(entries).where("session_id = '8' AND block_type = 'text'").collect()}
    assert said == {text for i, t, _, text in rows if i == 8 and (t % 3 == 0 or t % 2 == 0)}
