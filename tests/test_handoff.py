"""Open questions, task shifts, handoffs and recall on small sessions."""

from pyspark.sql import functions as F

from tracewell.operators import handoff, recall

ENTRY = "session_id string, seq long, role string, text string, has_call boolean, has_result boolean"


def test_pending_question(spark):
    rows = [
        ("asks", 1, "user", "do it", False, False), ("asks", 2, "assistant", "Done. One thing is open. Shall I merge it? Or wait?", False, False), ("asks", 3, "user", " ", False, False),
        ("answered", 1, "assistant", "Shall I?", False, False), ("answered", 2, "user", "yes", False, False),
        ("working", 1, "assistant", "Shall I?", True, False),
        ("result", 1, "assistant", "Shall I?", False, False), ("result", 2, "user", None, False, True),
        ("early", 1, "assistant", "Why? One. Two. Three.", False, False), ("states", 1, "assistant", "All is done.", False, False),
    ]
    got = handoff.pending_question(spark.createDataFrame(rows, ENTRY))
    assert [tuple(r) for r in got.collect()] == [("asks", "Shall I merge it? Or wait?")]


def test_task_shift(spark):
    talk = ["fix the login session cookie expiry", "refresh the cookie when login happens", "add tests for session refresh token", "rename cookie helper functions nicely please"]
    prompts = [("a", i * 10, t) for i, t in enumerate(talk)]
    prompts += [("a", 40, "design quarterly invoice export pipeline"), ("a", 50, "also write spreadsheet totals column footer"), ("a", 60, "tune parser grammar tokens"), ("a", 70, "short one"), ("b", 1, "design quarterly invoice export pipeline")]
    files = [("a", 55, "src/parser.ts"), ("a", 5, "src/unrelated/basket.py")]
    df = spark.createDataFrame(prompts, "session_id string, seq long, text string")
    fs = spark.createDataFrame(files, "session_id string, seq long, path string")
    for bucket in (F.lit(0), F.floor(F.col("seq") / 20)):
        got = {(r.session_id, r.seq) for r in handoff.task_shift(df, fs, bucket).where("shift").collect()}
        assert got == {("a", 40)}  # 30 shares cookie, 50 goes on, 60 names a file just touched, 70 is short, b has no history
    alts = spark.createDataFrame([("cookie", "invoice")], "term string, alt string")
    assert handoff.task_shift(df, fs, F.lit(0), synonyms=alts).where("shift").count() == 0


def test_handoff_fills_by_priority(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    prompts = t([("s", 1, "Please build the export of invoices to a file"), ("s", 2, "never touch the billing table by hand"), ("s", 5, "Now add a column with the tax of each invoice"), ("s", 8, "yes")], "session_id string, seq long, text string")
    replies = t([("s", 3, "Earlier reply " * 20), ("s", 6, "I looked at the tax code. " * 10), ("s", 7, "Shall the tax be rounded? " * 8)], "session_id string, seq long, text string")
    files = t([("s", "a.py", 3, 1), ("s", "b.py", 0, 4), ("s", "c.py", 5, 0)], "session_id string, path string, edits long, reads long")
    commands = t([("s", i, f"make t{i}") for i in range(8)], "session_id string, seq long, command string")
    facts = t([("s", 4, "decision", "We chose one file per month")], "session_id string, seq long, kind string, text string")
    todos = t([("s", 1, "completed", "old"), ("s", 2, None, "write docs")], "session_id string, nth long, status string, text string")
    checks = t([("s", "Last check: make test failed")], "session_id string, text string")
    asked = t([("s", "Shall the tax be rounded?")], "session_id string, question string")
    blocks = handoff.handoff_blocks(prompts, replies, files, commands, facts, todos, checks, asked)
    text = {r.block: r.text for r in blocks.collect()}
    assert text["goal"] == "Goal: Now add a column with the tax of each invoice"
    assert text["latest"].startswith('Latest message: "yes" (replying to: ') and "rounded?" in text["latest"]
    assert text["rules"] == "Rules:\n- User: never touch the billing table by hand" and text["todos"] == "Open todos:\n- [pending] write docs"
    assert text["replies"].count("> ") == 2 and "Earlier" not in text["replies"]
    assert text["changed"] == "Files changed:\n- c.py\n- a.py" and text["read"] == "Files read:\n- b.py"
    assert text["commands"] == "Recent commands:\n- make t3\n- make t4\n- make t5\n- make t6\n- make t7"
    assert text["requests"].split("\n")[1:] == ["- Please build the export of invoices to a file", "- never touch the billing table by hand"] and text["first"].startswith("Started with: Please build")
    whole = handoff.build_handoff(blocks).collect()[0]
    assert whole.n_blocks == 13 and whole.text.index("Goal:") < whole.text.index("Open question:") < whole.text.index("Files read:")
    few = handoff.build_handoff(blocks, 100, "Earlier work.").collect()[0]
    assert few.tokens <= 100 and few.text.startswith("Earlier work.\nGoal:") and "Last replies" not in few.text and "Last check" in few.text


def test_recall_spends_rises_and_forgets(spark):
    rules = recall.RecallRules(session_tokens=300, prompt_tokens=200, heading_tokens=10, least_tokens=60)
    cand = lambda seq, section, rank, key, coverage, tokens, words, like=0.0, older=False: ("s", seq, section, rank, key, 2.0, 6, coverage, tokens, older, words, like)
    rows = [
        cand(1, "memory", 1, "m1", 0.9, 50, ["a", "b"]), cand(1, "memory", 2, "m2", 0.9, 60, ["c"]), cand(1, "memory", 3, "m3", 0.9, 20, ["d"]), cand(1, "memory", 4, "m4", 0.1, 1, ["e"]),
        cand(1, "history", 5, "h1", 0.9, 10, ["a", "b", "c"]), cand(1, "history", 6, "h2", 0.9, 10, ["x"], 0.8), cand(1, "history", 7, "h3", 0.9, 10, ["y"]),
        cand(2, "memory", 1, "m1", 0.9, 50, ["a", "b"]), cand(2, "memory", 2, "m5", 0.4, 5, ["q"]), cand(2, "memory", 3, "m6", 0.42, 5, ["r"]), cand(2, "code", 4, "g1", 0.9, 40, ["z"]),
        cand(3, "compact", 0, "", 0.0, 0, []), cand(4, "memory", 1, "m1", 0.9, 50, ["a", "b"]), cand(4, "memory", 2, "m7", 0.4, 5, ["s"], 0.0, True),
    ]
    schema = "session_id string, seq long, section string, rank int, key string, matched double, n_terms int, coverage double, tokens int, older boolean, words array<string>, like_prompt double"
    df = spark.createDataFrame(rows + [("t", *r[1:]) for r in rows[:3]], schema).repartition(3)
    got = {}
    for r in recall.auto_recall(df, rules).orderBy("session_id", "seq", "used").collect():
        got.setdefault((r.session_id, r.seq), []).append(r.key)
    # m2 is too dear beside m1, m4 says too little, h1 is like m1, h2 like the prompt; later m1 was shown and the bar is above m5
    assert got == {("s", 1): ["m1", "m3", "h3"], ("s", 2): ["m6", "g1"], ("s", 4): ["m1"], ("t", 1): ["m1", "m3"]}
