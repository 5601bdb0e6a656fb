"""Registered queries against their check SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, duck

SF = "/root/testdata/sf0.01"
KEYS = ["corpus_grep", "large_reads", "alert_levels", "meter_no_double", "risky_commands", "usage_by_model", "usage_summary", "usage_by_day", "request_cost", "dedupe_replies", "secret_filter", "private_scrub", "hint_adoption", "tool_call_results", "token_estimate", "last_check", "recent_commands", "shell_reads", "asof_reply_before", "blocks_flatten", "stream_late", "facts_extract", "import_graph", "near_dup_notes", "prune_nodes", "task_shift", "relevant_code", "test_summary", "failure_clusters"]


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, key):
    assert compare(duck(SF), entry.queries()[key](spark, SF), entry.oracle_sql()[key]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_code_files(spark):
    from tracewell.sources.corpus import code_files

    rows = [("a/b.ts", "x"), ("node_modules/x.js", "y"), ("credentials.ts", "z"), ("credentials.json", "z"), ("k/.env.local", "s"), ("yarn.lock", "l"), ("big.py", "q" * 600_000), ("nul.bin2", "a\0b")]
    kept = code_files(spark.createDataFrame(rows, "rel string, text string")).select("rel", "large").collect()
    assert sorted(map(tuple, kept)) == [("a/b.ts", False), ("big.py", True), ("credentials.ts", False)]


def test_anchored_grep_and_alert_levels(spark):
    from pyspark.sql import functions as F

    from tracewell.operators.behaviour import alert_level
    from tracewell.operators.compaction import grep_lines, read_lines

    df = spark.createDataFrame([(1, "import a\nx\nimport b;\ny")], "k long, text string")
    assert [r.line_no for r in grep_lines(df, "k", "^import").collect()] == [1, 3]
    assert [r.line_no for r in grep_lines(df, "k", ";$").collect()] == [3]
    assert read_lines(df, "k", 1, 900).count() == 4
    values = spark.createDataFrame([(49,), (50,), (99,), (100,), (50 * 2**40,)], "v long")
    assert [r[0] for r in values.select(alert_level(F.col("v"), 50)).collect()] == [None, 1, 1, 2, 41]
