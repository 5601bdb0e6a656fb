"""Memory graph and prompt operators on small rows."""

from pyspark.sql import functions as F

from tracewell.operators import memory as M


def test_prompt_columns(spark):
    rows = [("ok",), ("Go ahead!",), ("/clear now please everyone",), ("fix it",), ("rename the parser module and update callers",), (None,), ("",), ("remember: always run the linter",), ("note - short",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(M.is_trivial(F.col("t")), M.remember_note(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, True, True, False, True]
    assert [r[1] for r in got][-2:] == ["always run the linter", None]
    named = spark.createDataFrame([("x\nWorking directory: /a/b/c/\ny",), ("cwd: /z",), ("none",), (None,)], "t string")
    assert [r[0] for r in named.select(M.guess_project(F.col("t"))).collect()] == ["c", "z", None, None]


def test_reply_before_is_strict(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", " "), (1, 3, "user", "r"), (1, 4, "assistant", "same time"), (1, 4, "user", "s"), (1, 500, "user", "late"), (2, 0, "user", "first")]
    items = spark.createDataFrame(rows, "s long, at long, role string, text string")
    got = {(r.s, r.at): r.reply for r in M.reply_before(items, "s", "at", F.floor(F.col("at") / 64)).collect()}
    assert got == {(1, 1): "hi", (1, 3): "hi", (1, 4): "hi", (1, 500): "same time", (2, 0): None}


def test_touches_and_paths(spark):
    nodes = spark.createDataFrame([("s1", "session", "p", 5), ("n1", "note", "p", 9), ("f1", "file", "p", 1), ("f2", "file", "p", 7), ("s2", "session", "p", 8)], "id string, type string, project string, updated int")
    edges = spark.createDataFrame([("s1", "f1", 3), ("f1", "n1", 2), ("gone", "f1", 9), ("s1", "s2", 1)], "a string, b string, w int")
    assert sorted((r.id, r.touches, r.updated) for r in M.graph_touches(edges, nodes).collect()) == [("f1", 5, 5), ("f2", 0, 7)]
    assert M.sweep(edges, nodes).count() == 3
    paths = spark.createDataFrame([(1, "a.py", True), (1, "a.py", False), (1, "../x", True), (1, "/etc/y", False)], "s int, p string, e boolean")
    assert [tuple(r) for r in M.session_files(paths, "s", "p", F.col("e")).collect()] == [(1, "a.py", 4)]


def test_one_reply_of_a_place(spark):
    """Replies at one place and a repeated prompt: a row per prompt."""
    rows = [("s", 1, "assistant", "a"), ("s", 1, "assistant", "b"), ("s", 2, "user", "x"), ("s", 2, "user", "x"), ("s", 0, "user", "first")]
    items = spark.createDataFrame(rows, "session string, at long, role string, text string")
    got = M.reply_before(items, "session", "at", F.lit(0))
    assert sorted((r.at, r.reply or "") for r in got.collect()) == [(0, ""), (2, "b"), (2, "b")]
