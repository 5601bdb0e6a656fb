"""History search on small sessions with known answers."""

import datetime as dt

from pyspark.sql import functions as F

from tracewell.operators import history as H

NOW = "2024-05-01 12:00:00"
ITEM = "item_id string, session_id long, who string, ts timestamp_ntz, text string"


def day(n, hour=12):
    return dt.datetime(2024, 5, 1, hour) - dt.timedelta(days=n)


def test_deep_union(spark):
    live = spark.createDataFrame([("a", 1, "x"), ("n", None, "x")], "item_id string, session_id long, text string")
    archived = spark.createDataFrame([("b", 1), ("c", 2), ("m", None)], "item_id string, session_id long")
    got = {(r.item_id, r.origin, r.text) for r in H.deep_union(live, archived, archived.limit(0), archived.where("session_id = 2")).collect()}
    assert got == {("a", "live", "x"), ("n", "live", "x"), ("c", "archive", None), ("m", "archive", None), ("c", "foreign", None)}


def test_search_order_copies_and_budget(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    same = "the parser of config tokens drops escaped quotes"
    rows = [
        ("a", 1, "tool result", day(1), same), ("b", 1, "you", day(1), same + " "), ("c", 2, "Claude", day(9), f"we decided: {same}"), ("d", 2, "Claude", None, f"then {same}"),
        ("e", 3, "you", day(0, 11), "nothing of that"), ("f", 3, "you", day(0), None), ("g", 3, "you", day(0), ""), ("h", 3, None, day(3), "x" * 900 + " parser of tokens " + "y" * 900),
    ]
    items = spark.createDataFrame(rows, ITEM)
    queries = spark.createDataFrame([(1, "parser config tokens"), (2, None), (3, "zebra")], "query_id long, text string")
    got = H.history_search(items, queries, now).orderBy("rank").collect()
    # b and a begin alike: the user's own words count more; c is older but states a decision; d has no time
    assert [(r.query_id, r.item_id) for r in got] == [(1, "b"), (1, "c"), (1, "d"), (1, "h")]
    assert got[0].line == f"- 24h ago · you: {same}" and got[2].line.startswith("- ? · Claude: then ")
    assert got[3].line.startswith("- 3d ago · ?: …xxx") and " parser of tokens " in got[3].line and got[3].line.endswith("y…")
    assert [r.item_id for r in H.history_search(items, queries, now, tokens=60).orderBy("rank").collect()] == ["b"]
    assert [r.item_id for r in H.history_search(items, queries, now, most=2).orderBy("rank").collect()] == ["b", "c"]
    assert H.history_search(items.limit(0), queries, now).count() == 0


def test_only_what_can_be_shown_is_kept(spark, monkeypatch):
    # 600 items hold the terms, most of them copies of a few beginnings
    kinds = ["parser of config", "config\n of  parser", "the parser, a config", " parser of config", "a" * 700 + " parser config " + "b" * 700]
    rows = [(f"i{i:03}", i % 9, ("you", "Claude", "tool result")[i % 3], day(i % 5), kinds[i % 5] + " x" * (i % 4) + (f" {i}" if i % 30 == 0 else "")) for i in range(600)]
    items = spark.createDataFrame(rows, ITEM).coalesce(1)
    queries = spark.createDataFrame([(1, "parser config"), (2, "config of nothing")], "query_id long, text string")
    now, kept, write = F.lit(NOW).cast("timestamp_ntz"), {}, H.written
    monkeypatch.setattr(H, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    got = [(r.query_id, r.item_id, r.score) for r in H.history_search(items, queries, now, tokens=100000).orderBy("query_id", "rank").collect()]
    few = kept["best"].count()
    kept.clear()
    everything = [(r.query_id, r.item_id, r.score) for r in H.history_search(items, queries, now, tokens=100000, most=5000).orderBy("query_id", "rank").collect()]
    assert got == [r for q in (1, 2) for r in [x for x in everything if x[0] == q][:10]] and len(got) == 20
    assert few < kept["best"].count() == 1200


def test_marks_of_equal_beginnings_are_equal(spark, monkeypatch):
    texts = ["a  b\n\nc" + "d " * 300, "a b c" + "d " * 300, "…a b c" + "d " * 300, " \t a" + " " * 500 + "b", "x" * 250 + " a  b" * 200, "x" * 250 + " a b" * 200, "a\u00a0b" * 70, ""]
    rows = [(t, p) for t in texts for p in (0, 1, 199, 200, 201, 230, 251, 300, 700)]
    keys = spark.createDataFrame(rows, "t string, p int").select("t", "p", F.substring(H.excerpt(F.col("t"), F.col("p")), 1, H.KEY_CHARS).alias("key")).collect()
    marks = {}
    for r in keys:
        marks.setdefault(r.key, set()).add(H.excerpt_marks(r.t, [r.p])[0])
    assert all(len(m) == 1 for m in marks.values()) and len(set.union(*marks.values())) > 8
    whole = [H.excerpt_marks(t, [p for s, p in rows if s == t]).tolist() for t in texts]
    monkeypatch.setattr(H, "_LONG", 610)
    assert [H.excerpt_marks(t, [p for s, p in rows if s == t]).tolist() for t in texts] == whole
