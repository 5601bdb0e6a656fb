"""Queries against their check SQL on small tables that once gave another result."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.harness import compare


def against_sql(spark, folder, key, **tables):
    """Writes ``tables`` (rows, schema) below ``folder`` and compares query and check SQL there."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return compare(con, entry.queries()[key](spark, str(folder)), entry.oracle_sql()[key])


DOCS = "doc_id long, text string"


def test_private_scrub_unclosed_tag_before_a_line_end(spark, tmp_path):
    rows = [(10, "a" * 49 + "\nmore"), (20, "one\n"), (3, "in the middle\n"), (30, "b" * 60)]
    assert against_sql(spark, tmp_path, "private_scrub", documents=(rows, DOCS)) is None


def test_task_shift_file_named_by_two_lines(spark, tmp_path):
    talk = ["fix login cookies soon", "refresh banner colours today", "rename helper functions nicely", "design quarterly rein export"]
    rows = [(0, i * 2, "user", t) for i, t in enumerate(talk)] + [(0, 1, "assistant", "Is to for.\nRein atea onre"), (0, 3, "assistant", "one two"), (0, 5, "assistant", "see the done.")]
    assert against_sql(spark, tmp_path, "task_shift", conversations=(rows, "conv_id long, turn int, role string, text string")) is None


def test_start_floor_notices_of_replies_without_context(spark, tmp_path):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    rows = [(i, at(i), 0, kind, value, '{"k": %d}' % k) for i, (kind, value, k) in enumerate([("error", 5.0, 3), ("click", 9.5, 40), ("view", 0.0, 0), ("error", 0.0, 0), ("click", 7.25, 95), ("view", 3.0, 4)])]
    events = (rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    assert against_sql(spark, tmp_path, "start_floor", events=events) is None


@pytest.mark.parametrize(("chars", "kept", "changed"), [(90, 63, True), (90, 64, False), (100, 70, True), (91, 64, False)])
def test_summary_of_exactly_the_share(spark, chars, kept, changed):
    from tracewell.operators.compaction import test_summary

    line = spark.range(1).select(
        F.col("id"), F.lit("prose").alias("framework"), F.lit(chars).alias("text_chars"), F.lit(1).alias("n_lines"), F.lit(0).alias("pos"), F.lit("x" * kept).alias("line"),
        F.lit(False).alias("is_pass"), F.lit(True).alias("is_fail"), F.lit(0).cast("bigint").alias("passes"), F.lit(True).alias("keep"),
    )
    assert test_summary(line, "id").first().changed is changed


PROMPTS = [(0, "art fair stand opens"), (1, "of all the cat and dog"), (2, "Heart fair. Two clauses stand here! One fair clause opens"), (3, "zzzz yyyy xxxx wwww")]
SEARCHED = [(0, "In heart fair stand opens, once"), (1, "ART fair stand opens"), (2, "fair " * 30 + "stand"), (3, "concat and dog"), (4, "of all the cat and dog."), (5, "art"), (6, "nothing")]


@pytest.mark.parametrize("key", ["bm25_rank", "bm25_segments", "bm25_gate", "retrieval_eval"])
def test_search_phrase_inside_a_word(spark, tmp_path, key):
    # "heart fair ..." holds the prompt "art fair ..." though the short word "art" does not count there
    assert against_sql(spark, tmp_path, key, documents=(SEARCHED, DOCS), benchmark=(PROMPTS, "item_id long, text string")) is None


def test_term_counts_reads_a_text_once(spark):
    from tracewell.operators.search import term_counts

    docs = spark.createDataFrame([(1, "some words")], "k long, text string")
    counts = term_counts(docs, "k", "text", spark.createDataFrame([("word",)], "term string"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    lowered = [i for i, line in enumerate(plan) if "lower(" in line]
    below = lambda i: plan[i + 1 : next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))]
    assert lowered and not any("Generate" in line for i in lowered for line in below(i))  # not worked out again for each run
