"""Memory graph: nodes (id, type, project, updated), edges (a, b, w), and what conversations add to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ordered import last_value, with_carried
from tracewell.operators.search import STOP

# --- fixed values: replies that hold nothing to recall, and how a note to keep begins ---
TRIVIAL = r"(?i)^\s*(ok(ay)?|k|yes|yep|yeah|no|nope|y|n|sure|thanks?( you)?|ty|thx|go( ahead| on)?|continue|proceed|do it|lgtm|done|next|great|nice|cool|perfect|good|right|please|again|retry|try again|keep going|sounds good|looks good|ship it|merge it)[\s.!?]*$"
REMEMBER = r"(?i)^\s*(?:remember|note)\s*[:,-]?\s+(.{8,})"
WORKING_DIR = r"(?i)Working directory:\s*(\S+)"
CWD = r"(?i)\bcwd[:=]\s*(\S+)"


def session_files(touches: DataFrame, session: str, path: str, is_edit: Column) -> DataFrame:
    """Edges of sessions to the files below the project: weight = touches + 2 x edits."""
    inside = touches.where(~F.col(path).rlike(r"^(\.\.|/)") & (F.col(path) != ""))
    weight = F.count("*") + 2 * F.count_if(is_edit)
    return inside.groupBy(session, path).agg(weight.cast("long").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node's neighbours with their type, in both directions."""
    return both_ways(edges).join(nodes.select(F.col("id").alias("b"), F.col("type").alias("b_type")), "b")


def sweep(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def graph_touches(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """File and topic nodes with ``touches``, the weights of their edges to sessions, digests and notes, and
    ``updated``, moved on to the last session that touched them.  Edges are summed before the nodes join."""
    near = both_ways(edges).join(nodes.select(F.col("id").alias("b"), "type", F.col("updated").alias("seen")), "b")
    near = near.where(F.col("type").isin("session", "digest", "note"))
    sums = near.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("w"), F.max(F.when(F.col("type") == "session", F.col("seen"))).alias("seen"))
    touched = nodes.where(F.col("type").isin("file", "topic")).join(sums, "id", "left")
    return touched.select("id", "type", "project", F.coalesce("w", F.lit(0)).cast("long").alias("touches"), F.greatest("updated", "seen").alias("updated"))


def memory_pivot(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes of every type per project, and when the project was last active."""
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types]
    return nodes.groupBy("project").agg(*counts, F.max("updated").alias("last_active"))


def is_trivial(text: Column, stop=STOP) -> Column:
    """An acknowledgement, a slash command, or fewer than three content words."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_][A-Za-z0-9_./-]*"), 0), lambda w: (F.char_length(w) >= 3) & ~F.lower(w).isin(*stop))
    return F.coalesce(text.rlike(TRIVIAL) | F.ltrim(text).startswith("/") | (F.size(words) < 3), F.lit(True))


def remember_note(text: Column) -> Column:
    """What a prompt asks to remember (to the end of its line), else null."""
    return F.trim(F.nullif(F.regexp_extract(text, REMEMBER, 1), F.lit("")))


def guess_project(system: Column) -> Column:
    """Last part of the working directory that a system prompt names."""
    named = lambda p: F.nullif(F.regexp_extract(system, p, 1), F.lit(""))
    parts = F.filter(F.split(F.coalesce(named(WORKING_DIR), named(CWD)), "/"), lambda s: s != "")
    return F.get(parts, F.size(parts) - 1)


def reply_before(items: DataFrame, session: str, order: str, bucket: Column) -> DataFrame:
    """Every prompt with the last non-empty reply strictly before it, or null.

    Only the reply's place is carried along the session; its text joins the prompts at the end.
    """
    reply = (F.col("role") == "assistant") & (F.trim("text") != "")
    slim = items.select(session, order, "role", F.coalesce(reply, F.lit(False)).alias("__reply"))
    # a prompt comes before a reply of the same time, so that it does not see it
    placed = with_carried(slim, [session], [order, "__reply"], [last_value("reply_at", F.when(F.col("__reply"), F.col(order)))], bucket)
    prompts = placed.where("role = 'user'").select(session, order, "reply_at")
    # of several replies at one place the largest text counts
    texts = items.where(reply).groupBy(session, F.col(order).alias("reply_at")).agg(F.max("text").alias("reply"))
    return prompts.join(texts, [session, "reply_at"], "left")
