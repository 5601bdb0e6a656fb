"""Upkeep of the memory graph: re-ingest, monthly digests, near-duplicate notes, caps, and all of it in one run.

Nodes: id, type, project, label, created, updated, weight, touches, pinned, auto, kind, started, prompt_count,
sessions, highlights (a digest's ``prompt_count`` is that of its sessions).  Edges: a < b, w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.memory import both_ways, graph_touches, sweep
from tracewell.operators.similar import first_similar, word_set
from tracewell.session import written

# --- fixed values ---
FOLD_DAYS, HIGHLIGHTS, DIGEST_WEIGHT, DIGEST_SHARE = 21, 12, 5.0, 5
SIMILAR, MERGE_ROUNDS = 0.6, 5
PIN_BONUS, HALF_LIFE_DAYS = 3.0, 14
MOST_FACTS, MOST_AUTO_PINS, MOST_NODES, RECENT_DAYS, TRIVIA = 60, 6, 400, 2, 0.05
QUIET_MINUTES, FORGET_DAYS = 0, 7
EXPORTED_LINKS, ROOT_SCORE = 40, 10.0

NODE = (
    "id string, type string, project string, label string, created timestamp_ntz, updated timestamp_ntz, weight double, touches bigint, pinned boolean, "
    "auto boolean, kind string, started timestamp_ntz, prompt_count bigint, sessions bigint, highlights array<string>"
)
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
#: What a batch adds to or changes in a node that exists.
DATA = ["pinned", "auto", "kind", "started", "prompt_count", "sessions", "highlights"]


def days_since(as_of: Column, ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, as_of) / 86_400_000_000


def decay_score(as_of: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Weight, pin and touches, halved every ``half_life`` days without an update; a project is above all."""
    worth = F.col("weight") + F.when(F.col("pinned"), PIN_BONUS).otherwise(0.0) + F.log1p("touches")
    age = F.greatest(F.lit(0.0), days_since(as_of, F.col("updated")))
    return F.when(F.col("type") == "project", F.lit(float("inf"))).otherwise(worth * F.pow(F.lit(0.5), age / half_life))


def summed(edges: DataFrame) -> DataFrame:
    """Edges between two nodes, the smaller id first, once, with the sum of their weights."""
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    return ends.groupBy("a", "b").agg(F.sum("w").alias("w"))


def repointed(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """``edges`` with the ends in ``moved`` (id, to) replaced; what then joins a node with itself goes."""
    for end in ("a", "b"):
        edges = edges.join(moved.select(F.col("id").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return summed(edges)


def upsert_nodes(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """``nodes`` with those of ``batch`` (id, type, project, label, updated, weight, touches and any of ``DATA``).

    A node that exists keeps its creation, weight and touches, moves on to the later ``updated``, and takes
    the label and data that the batch has (null: what it had).  Of several rows of a node in the batch the
    later one counts, column by column.  Doing it twice changes nothing.
    """
    own = [c for c in COLUMNS if c in batch.columns and c not in ("id", "updated")]
    # ties of time: the larger value, so that the order of rows does not matter
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("updated", c))).alias(c) for c in own]
    once = batch.groupBy("id").agg(F.max("updated").alias("updated"), F.min("updated").alias("created"), *last).alias("n")
    both = nodes.alias("o").join(once, "id", "full_outer")
    old, new = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    out = {"created": F.coalesce(old("created"), new("created")), "updated": F.greatest(old("updated"), new("updated")), "label": F.coalesce(F.nullif(new("label"), F.lit("")), old("label"))}
    for c in COLUMNS:
        if c in ("id", *out):
            continue
        given = new(c) if c in own else F.lit(None)
        out[c] = F.coalesce(given, old(c)) if c in DATA else F.coalesce(old(c), given)
    out["weight"], out["touches"] = F.coalesce(out["weight"], F.lit(1.0)), F.coalesce(out["touches"], F.lit(0))
    out["pinned"], out["auto"] = F.coalesce(out["pinned"], F.lit(False)), F.coalesce(out["auto"], F.lit(False))
    return both.select("id", *[out[c].alias(c) for c in COLUMNS[1:]])


def replace_edges(edges: DataFrame, batch: DataFrame, sessions: DataFrame) -> DataFrame:
    """``edges`` in which those of ``sessions`` (id) are the ones of ``batch``: a session ingested again counts once."""
    kept = edges
    for end in ("a", "b"):
        kept = kept.join(sessions.select(F.col("id").alias(end)).distinct(), end, "left_anti")
    return summed(kept.select("a", "b", "w").unionByName(batch.select("a", "b", "w")))


def fold_digests(nodes: DataFrame, edges: DataFrame, as_of: Column, days: float = FOLD_DAYS) -> tuple[DataFrame, DataFrame]:
    """Sessions not updated for ``days`` become part of their project's digest of the month they started in.

    A digest adds up sessions, prompts and touches, keeps the first labels (oldest session first) up to 12,
    and takes over the sessions' edges.  A digest that exists goes on.  Folding again finds nothing.
    """
    month = F.date_format(F.coalesce("started", "updated"), "yyyy-MM")
    old = nodes.where((F.col("type") == "session") & (days_since(as_of, F.col("updated")) >= days))
    old = written(old.withColumns({"month": month, "to": F.concat(F.lit("digest:"), "project", F.lit(":"), month)}), "folded")
    nth = F.row_number().over(W.partitionBy("to").orderBy("updated", "id"))
    first = old.withColumn("nth", nth).where(F.col("nth") <= HIGHLIGHTS).groupBy("to").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "label"))), lambda x: x["label"]).alias("new_highlights"))
    sums = old.groupBy("to", "project", "month").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("prompt_count", F.lit(0))).alias("n_prompts"), F.sum("touches").alias("n_touches"), F.min("updated").alias("since"), F.max("updated").alias("last")
    )
    name = F.regexp_replace("project", "~[0-9a-f]{6}$", "")
    sums = sums.join(first, "to").select(F.col("to").alias("id"), F.col("project").alias("project_"), F.concat(name, F.lit(" "), "month").alias("label_"), "n", "n_prompts", "n_touches", "since", "last", "new_highlights")
    grown = nodes.where("type = 'digest'").join(sums, "id", "full_outer")
    count = F.coalesce("sessions", F.lit(0)) + F.coalesce("n", F.lit(0))
    empty = F.array().cast("array<string>")
    digests = grown.select(
        "id", F.lit("digest").alias("type"), F.coalesce("project", "project_").alias("project"), F.coalesce("label_", "label").alias("label"), F.coalesce("created", "since").alias("created"),
        F.greatest("updated", "last").alias("updated"), F.when(F.col("n").isNull(), F.col("weight")).otherwise(F.least(F.lit(DIGEST_WEIGHT), 1 + count / DIGEST_SHARE)).alias("weight"),
        (F.coalesce("touches", F.lit(0)) + F.coalesce("n_touches", F.lit(0))).alias("touches"), F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("auto", F.lit(False)).alias("auto"), "kind", "started",
        (F.coalesce("prompt_count", F.lit(0)) + F.coalesce("n_prompts", F.lit(0))).alias("prompt_count"), count.alias("sessions"),
        F.slice(F.concat(F.coalesce("highlights", empty), F.coalesce("new_highlights", empty)), 1, HIGHLIGHTS).alias("highlights"),
    )
    rest = nodes.where("type <> 'digest'").join(old.select("id"), "id", "left_anti")
    return rest.select(*COLUMNS).unionByName(digests), repointed(edges, old.select("id", "to"))


def near_dup_notes(notes: DataFrame, at_least: float = SIMILAR) -> DataFrame:
    """(id, leader): every note with the earliest note (created, id) of its project that it merges into, or itself."""
    order = F.struct("created", "id")
    first = first_similar(notes.select("project", order.alias("id"), word_set(F.col("label")).alias("words")), ["project"], at_least)
    return first.select("id.id", F.col("first.id").alias("leader"))


def merge_notes(nodes: DataFrame, edges: DataFrame, at_least: float = SIMILAR, rounds: int = MERGE_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Notes of a project that say the same become one: the earliest, with the longest label, the largest weight,
    the last update, a pin if any has one, and the touches of all, one more for each that merged.

    Likeness is that of the labels at the start of a round; a label that grew may merge more, so rounds go
    on until nothing merges, ``rounds`` at most.  Edges follow once, after the last round.
    """
    notes, rest, gone = nodes.where("type = 'note'"), nodes.where("type <> 'note'"), None
    for _ in range(rounds):
        leaders = written(near_dup_notes(notes, at_least), "leaders")
        moved = leaders.where("id <> leader").select("id", F.col("leader").alias("to"))
        if moved.isEmpty():
            break
        joined = notes.join(leaders, "id")
        own = F.max_by(F.struct(*COLUMNS), F.col("id") == F.col("leader")).alias("own")
        label = F.min_by("label", F.struct(-F.char_length("label"), F.col("created"), F.col("id")))
        merged = joined.groupBy("leader").agg(own, label.alias("label"), F.max("weight").alias("weight"), F.max("updated").alias("updated"), F.bool_or("pinned").alias("pinned"), (F.sum("touches") + F.count("*") - 1).alias("touches"))
        changed = ("label", "weight", "updated", "pinned", "touches")
        notes = written(merged.select(*[F.col(c) if c in changed else F.col(f"own.{c}").alias(c) for c in COLUMNS]), "notes")
        if gone is not None:  # what went before to a note that now goes too goes on with it
            then = moved.select(F.col("id").alias("to"), F.col("to").alias("on"))
            moved = gone.join(then, "to", "left").select("id", F.coalesce("on", "to").alias("to")).unionByName(moved)
        gone = written(moved, "gone")
    if gone is not None:
        edges = written(repointed(edges, gone), "edges")
    return rest.select(*COLUMNS).unionByName(notes.select(*COLUMNS)), edges


def cap_auto_pins(nodes: DataFrame, most: int = MOST_AUTO_PINS) -> DataFrame:
    """Of notes pinned by the program the ``most`` newest of a project stay pinned; pins by hand are not touched."""
    auto = F.coalesce((F.col("type") == "note") & F.col("pinned") & F.col("auto"), F.lit(False))
    newest = F.row_number().over(W.partitionBy("project").orderBy(F.col("updated").desc(), "id"))
    stay = nodes.where(auto).select("id", "project", "updated").withColumn("nth", newest).where(F.col("nth") <= most).select("id", F.lit(True).alias("stay"))
    loose = auto & F.col("stay").isNull()
    return nodes.join(stay, "id", "left").select(*[F.when(loose, F.lit(False)).otherwise(F.col(c)).alias(c) if c in ("pinned", "auto") else F.col(c) for c in COLUMNS])


def cap_facts(nodes: DataFrame, as_of: Column, most: int = MOST_FACTS, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Notes that were captured (they have a kind) and are not pinned: the ``most`` best of a project stay."""
    fact = F.coalesce((F.col("type") == "note") & F.col("kind").isNotNull() & ~F.col("pinned"), F.lit(False))
    best = F.row_number().over(W.partitionBy("project").orderBy(F.col("s").desc(), "id"))
    stay = nodes.where(fact).select("id", "project", F.round(decay_score(as_of, half_life), 9).alias("s")).withColumn("nth", best).where(F.col("nth") <= most)
    return nodes.where(~fact).unionByName(nodes.where(fact).join(stay.select("id"), "id", "left_semi"))


def cap_nodes(nodes: DataFrame, as_of: Column, most: int = MOST_NODES, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Projects above ``most`` nodes lose the lowest scores; projects, digests, pinned nodes and sessions of the
    last two days stay.  At most ``most`` nodes of a project have to be ranked."""
    fixed = F.col("type").isin("project", "digest") | F.coalesce("pinned", F.lit(False))
    fixed = fixed | ((F.col("type") == "session") & (days_since(as_of, F.col("updated")) < RECENT_DAYS))
    counts = nodes.groupBy("project").agg(F.count("*").alias("total"), F.count_if(~fixed).alias("free"))
    counts = counts.where(F.col("total") > most).select("project", F.greatest(F.lit(0), F.col("free") - (F.col("total") - most)).alias("room"))
    full = nodes.join(counts, "project")
    best = F.row_number().over(W.partitionBy("project").orderBy(F.col("s").desc(), "id"))
    ranked = full.where(~fixed).select("id", "project", "room", F.round(decay_score(as_of, half_life), 9).alias("s")).withColumn("nth", best).where(F.col("nth") <= most)
    stay = ranked.where("nth <= room").select("id")
    kept = full.where(fixed).select(*COLUMNS).unionByName(full.where(~fixed).join(stay, "id", "left_semi").select(*COLUMNS))
    return nodes.join(counts, "project", "left_anti").select(*COLUMNS).unionByName(kept)


def with_touches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` whose files and topics have touches and last update taken from their edges."""
    now = graph_touches(edges, nodes).select("id", F.col("touches").alias("t"), F.col("updated").alias("u"))
    new = {"touches": F.coalesce("t", "touches"), "updated": F.coalesce("u", "updated")}
    return nodes.join(now, "id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in COLUMNS])


def prune_nodes(nodes: DataFrame, edges: DataFrame, as_of: Column, most_facts: int = MOST_FACTS, most_nodes: int = MOST_NODES, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Caps in their order: captured facts, then touches anew, nodes of a project, then topics and files nobody needs."""
    left = written(with_touches(cap_facts(nodes.select(*COLUMNS), as_of, most_facts, half_life), edges), "touched")
    left = cap_nodes(left, as_of, most_nodes, half_life)
    return left.where(~(F.col("type").isin("topic", "file") & (decay_score(as_of, half_life) < TRIVIA)))


def consolidate(nodes: DataFrame, edges: DataFrame, as_of: Column, half_life: float = HALF_LIFE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report): fold, merge, cap and sweep.  Each step is written, so a lost executor repeats
    none of the steps before.  ``report`` counts the nodes folded, merged and pruned, and what is left."""
    n = nodes.count()
    nodes, edges = fold_digests(nodes, edges, as_of)
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    digests = nodes.where("type = 'digest'")
    folded = digests.agg(F.coalesce(F.sum("sessions"), F.lit(0))).first()[0]
    before = nodes.count()
    nodes, edges = merge_notes(nodes, edges)
    nodes = written(nodes, "nodes")
    merged = before - nodes.count()
    nodes = written(prune_nodes(nodes, edges, as_of, half_life=half_life), "nodes")
    left = nodes.count()
    edges = written(sweep(edges, nodes), "edges")
    report = nodes.sparkSession.createDataFrame([(n, folded, merged, before - merged - left, left, edges.count())], "nodes_before long, folded long, merged long, pruned long, nodes long, edges long")
    return nodes, edges, report


def pending_ingest(buffers: DataFrame, nodes: DataFrame, as_of: Column, quiet_minutes: float = QUIET_MINUTES) -> DataFrame:
    """(session_id, action): buffers (session_id, modified, usable) quiet for long enough and changed since their
    session was ingested (``nodes``: session_id, ingested_at): ``ingest``, or ``drop`` if of no use for a week."""
    quiet = buffers.where(days_since(as_of, F.col("modified")) * 1440 >= quiet_minutes)
    due = quiet.join(nodes.select("session_id", "ingested_at"), "session_id", "left").where(F.col("ingested_at").isNull() | (F.col("ingested_at") < F.col("modified")))
    stale = days_since(as_of, F.col("modified")) > FORGET_DAYS
    return due.select("session_id", F.when(F.col("usable"), "ingest").when(stale, "drop").alias("action")).where("action IS NOT NULL")


def graph_export(nodes: DataFrame, edges: DataFrame, as_of: Column, half_life: float = HALF_LIFE_DAYS, links: int = EXPORTED_LINKS) -> DataFrame:
    """(project, type, id, label, updated, score, links): every node with its heaviest neighbours (ties: by id) and
    its score, 10 for a project; written by project and type it is what a viewer shows."""
    name = nodes.select(F.col("id").alias("b"), F.col("label").alias("b_label"))
    near = both_ways(edges).join(name, "b")
    nth = F.row_number().over(W.partitionBy("a").orderBy(F.col("w").desc(), "b"))
    near = near.withColumn("nth", nth).where(F.col("nth") <= links).groupBy(F.col("a").alias("id"))
    near = near.agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "b_label"))), lambda x: x["b_label"]).alias("links"))
    worth = F.when(F.col("type") == "project", ROOT_SCORE).otherwise(F.round(decay_score(as_of, half_life), 2))
    out = nodes.withColumn("score", worth).join(near, "id", "left")
    return out.select("project", "type", "id", "label", "updated", "score", F.coalesce("links", F.array().cast("array<string>")).alias("links"))
