"""Upkeep of a small memory graph: goldens, and that doing a step twice changes nothing."""

import datetime as dt

from pyspark.sql import functions as F

from tracewell.operators import upkeep as U

NOW = dt.datetime(2024, 6, 1)
AS_OF = "timestamp_ntz'2024-06-01'"
NAMES = U.COLUMNS


def ago(days):
    return NOW - dt.timedelta(days=days)


def node(id, type, days=0.0, **more):
    row = dict(id=id, type=type, project="p~abcdef", label=id, created=ago(days), updated=ago(days), weight=1.0, touches=0, pinned=False, auto=False) | more
    return tuple(row.get(c) for c in NAMES)


def nodes(spark, rows):
    return spark.createDataFrame(rows, U.NODE)


def edges(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, w long")


def as_of():
    return F.expr(AS_OF)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_fold_thirty_old_sessions(spark):
    rows = [node(f"s{i:02}", "session", 40 + i / 100, touches=2, prompt_count=3, started=ago(41)) for i in range(30)] + [node("new", "session", 3), node("f", "file", 1), node("g", "file", 1)]
    links = [(f"s{i:02}", "f", 1) for i in range(30)] + [("f", "new", 5), ("s00", "s01", 1), ("g", "s05", 2)]
    got, left = U.fold_digests(nodes(spark, rows), edges(spark, links), as_of())
    found = by_id(got)
    digest = found["digest:p~abcdef:2024-04"]
    assert set(found) == {"new", "f", "g", "digest:p~abcdef:2024-04"}
    assert (digest.label, digest.sessions, digest.prompt_count, digest.touches, digest.weight) == ("p 2024-04", 30, 90, 60, 5.0)
    assert digest.highlights == [f"s{i:02}" for i in range(29, 17, -1)]  # the oldest first
    want = {("digest:p~abcdef:2024-04", "f", 30), ("digest:p~abcdef:2024-04", "g", 2), ("f", "new", 5)}
    assert {tuple(r) for r in left.collect()} == want
    again, same = U.fold_digests(got, left, as_of())
    assert by_id(again) == found and {tuple(r) for r in same.collect()} == want


def test_merge_notes(spark):
    rows = [
        node("a", "note", 9, label="Use the queue for mail", weight=1.5, touches=1), node("b", "note", 5, label="use the queue for mail!", touches=2, pinned=True), node("c", "note", 4, label="use the queue for all mail", weight=2.0),
        node("d", "note", 3, label="cache the page", kind="cause"), node("e", "note", 2, label="use the queue for mail", project="q"), node("x", "note", 1, label="!!"), node("y", "note", 1, label="??"), node("t", "topic", 1),
    ]
    merged, left = U.merge_notes(nodes(spark, rows), edges(spark, [("a", "t", 1), ("b", "t", 2), ("a", "b", 7), ("c", "d", 1)]))
    found = by_id(merged)
    assert set(found) == {"a", "d", "e", "x", "y", "t"}
    a = found["a"]
    assert (a.label, a.weight, a.touches, a.pinned, a.updated) == ("use the queue for all mail", 2.0, 5, True, ago(4))
    assert {tuple(r) for r in left.collect()} == {("a", "t", 3), ("a", "d", 1)}


def test_edges_follow_merged_notes_once(spark, monkeypatch):
    """A note that goes to one which goes in a later round: its edges end at the last, and are written once."""
    a, b = node("a", "note", 9, label="k l m n o p"), node("b", "note", 8, label="k l m n q")
    c, d = node("c", "note", 7, label="k l m n q r s"), node("d", "note", 6, label="q r s k l m")
    steps, real = [], U.written
    monkeypatch.setattr(U, "written", lambda df, name: (steps.append(name), real(df, name))[1])
    e = edges(spark, [("a", "t", 1), ("b", "t", 2), ("c", "t", 4), ("d", "t", 8), ("b", "c", 16)])
    n, left = U.merge_notes(nodes(spark, [a, b, c, d]), e)
    rounds = steps.count("notes")
    to = {r.id for r in n.collect()}
    assert rounds > 1 and steps.count("edges") == 1 and sum(r.w for r in left.collect() if r.b == "t") == 15
    assert all(x in to or x == "t" for r in left.collect() for x in (r.a, r.b))


def test_upsert_twice(spark):
    old = nodes(spark, [node("s1", "session", 5, label="one", weight=2.0, touches=4, prompt_count=1), node("s2", "session", 5)])
    batch = spark.createDataFrame(
        [("s1", "session", "p", "", ago(1), 9, None), ("s1", "session", "p", None, ago(2), 8, ago(3)), ("s3", "session", "p", "three", ago(1), 2, None)], "id string, type string, project string, label string, updated timestamp_ntz, prompt_count long, started timestamp_ntz"
    )
    once = U.upsert_nodes(old, batch)
    found = by_id(once)
    s1 = found["s1"]
    assert (s1.label, s1.created, s1.updated, s1.weight, s1.touches, s1.prompt_count, s1.started) == ("one", ago(5), ago(1), 2.0, 4, 9, ago(3))
    assert (found["s3"].label, found["s3"].created, found["s3"].weight, found["s3"].touches, found["s3"].pinned) == ("three", ago(1), 1.0, 0, False)
    assert by_id(U.upsert_nodes(once, batch)) == found
    e = edges(spark, [("a", "s1", 1), ("s1", "b", 2), ("a", "b", 3)])
    new, sessions = edges(spark, [("s1", "a", 4), ("a", "s1", 1)]), spark.createDataFrame([("s1",)], "id string")
    for _ in range(2):
        e = U.replace_edges(e, new, sessions)
        assert {tuple(r) for r in e.collect()} == {("a", "s1", 5), ("a", "b", 3)}


def test_caps(spark):
    auto = [node(f"n{i}", "note", i, pinned=True, auto=True) for i in range(8)] + [node("hand", "note", 99, pinned=True)]
    assert {r.id for r in U.cap_auto_pins(nodes(spark, auto)).where("pinned").collect()} == {f"n{i}" for i in range(6)} | {"hand"}
    facts = [node(f"k{i:02}", "note", i, kind="cause", label=f"w{i}") for i in range(70)] + [node("pin", "note", 400, kind="cause", pinned=True)]
    left = U.cap_facts(nodes(spark, facts), as_of())
    assert {r.id for r in left.collect()} == {f"k{i:02}" for i in range(60)} | {"pin"}
    many = [node(f"f{i:03}", "file", i / 10, touches=1) for i in range(50)] + [node("s", "session", 1, weight=0.0), node("d", "digest", 90), node("p", "project", 900)]
    assert {r.id for r in U.cap_nodes(nodes(spark, many), as_of(), 10).collect()} == {f"f{i:03}" for i in range(7)} | {"s", "d", "p"}
    stale = U.prune_nodes(nodes(spark, [node("old", "file", 200), node("near", "file", 1), node("used", "file", 200), node("s", "session", 1)]), edges(spark, [("s", "used", 3)]), as_of())
    assert {r.id: r.touches for r in stale.collect()} == {"near": 0, "used": 3, "s": 0}


def test_consolidate_three_thousand_nodes(spark):
    """300 sessions with 8 files each: folded, capped and swept, and a second run changes nothing more."""
    rows = [node(f"s{i}", "session", 10 + i / 5, touches=1, prompt_count=2) for i in range(300)] + [node(f"f{j}", "file", 5) for j in range(2400)] + [node("p", "project", 0)]
    links = [(f"f{i * 8 + k}", f"s{i}", 1) for i in range(300) for k in range(8)]
    n, e, report = U.consolidate(nodes(spark, rows), edges(spark, links), as_of())
    r = report.collect()[0]
    assert r.nodes_before == 2701 and r.folded == 245 and r.merged == 0 and r.nodes == n.count() <= 400 and r.edges == e.count()
    ids = {x.id for x in n.collect()}
    assert all(x.a in ids and x.b in ids for x in e.collect()) and "p" in ids
    again = U.consolidate(n, e, as_of())[2].collect()[0]
    assert again.nodes == r.nodes and again.merged == again.pruned == 0 and again.edges == r.edges


def test_pending_and_export(spark):
    buffers = spark.createDataFrame([("new", ago(0.1), True), ("busy", ago(0.0001), True), ("done", ago(1), True), ("more", ago(1), True), ("empty", ago(1), False), ("stale", ago(8), False)], "session_id string, modified timestamp_ntz, usable boolean")
    known = spark.createDataFrame([("done", ago(0.5)), ("more", ago(2))], "session_id string, ingested_at timestamp_ntz")
    got = {r.session_id: r.action for r in U.pending_ingest(buffers, known, as_of(), 5).collect()}
    assert got == {"new": "ingest", "more": "ingest", "stale": "drop"}
    rows = [node("p", "project"), node("f", "file", 14, touches=0), node("s", "session")]
    out = by_id(U.graph_export(nodes(spark, rows), edges(spark, [("f", "s", 1), ("f", "p", 5)]), as_of(), links=1))
    assert (out["p"].score, out["f"].score, out["f"].links, out["s"].links) == (10.0, 0.5, ["p"], ["f"])
