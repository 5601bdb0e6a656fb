"""What a session hands on to the next one: blocks by priority under a budget; questions left open, task shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.ordered import last_value, running_sum, with_carried
from tracewell.functions.text import squash, token_estimate
from tracewell.operators.budget import budget_skip
from tracewell.operators.memory import is_trivial
from tracewell.operators.search import STOP, query_terms
from tracewell.session import written

# --- fixed values ---
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"
CORRECTION = r"(?i)^(?:no[,.!]?\s|nope|wrong|that'?s not|not like that|don'?t|do not|stop|never|always|instead|actually|i said|i meant|from now on|please don'?t)"
CONTINUATION = r"(?i)^\s*(also|and|then|now|next|ok(ay)?|great|thanks?|thx|cool|yes|yep|no|but|so|continue|keep|same|again|that|it|this|these|those|why|what about|how about|can you also|one more|last|finally|actually|wait|hmm)\b"
HANDOFF_TOKENS, SUBSTANTIVE = 1200, 25
SHIFT_TERMS, SHIFT_PROMPTS, RECENT_PROMPTS, RECENT_FILES = 4, 3, 6, 30
#: Priority and reading place of each block.
BLOCKS = {
    "goal": (1, 1), "latest": (1, 2), "question": (2, 3), "rules": (2, 4), "todos": (3, 6), "check": (3, 7), "replies": (4, 8),
    "decisions": (5, 9), "changed": (6, 10), "requests": (7, 11), "first": (8, 12), "commands": (9, 13), "read": (10, 14),
}


def one_line(text: Column, most: int) -> Column:
    """The text on one line, cut to ``most`` characters with a mark."""
    flat = F.trim(squash(text))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def pending_question(entries: DataFrame, ask: str = r"\?", most: int | None = None) -> DataFrame:
    """(session_id, question): what the last reply ended on, if nothing came after it.

    ``entries``: session_id, seq, role (user, assistant), text, has_call, has_result; main chain.  A reply
    with a call is still at work; an entry without text counts only if it has a call or a result.  The
    question is those of the last three sentences that ask.
    """
    counts = (F.trim(F.coalesce("text", F.lit(""))) != "") | F.col("has_call") | F.col("has_result")
    last = entries.where(F.coalesce(counts, F.lit(False))).groupBy("session_id").agg(F.max_by(F.struct("role", "text", "has_call"), "seq").alias("e")).select("session_id", "e.*")
    sentences = F.filter(F.transform(F.split("text", SENTENCE_BREAK), F.trim), lambda s: s != "")
    tail = F.slice(sentences, F.greatest(F.lit(1), F.size(sentences) - 2), 3)
    asked = F.filter(tail, lambda s: s.rlike(ask))
    question = F.array_join(asked, " ")
    found = last.where((F.col("role") == "assistant") & ~F.col("has_call") & (F.size(asked) > 0))
    return found.select("session_id", (question if most is None else one_line(question, most)).alias("question"))


def task_shift(prompts: DataFrame, files: DataFrame, bucket: Column, stop: Sequence[str] = STOP, continues: str = CONTINUATION, synonyms: DataFrame | None = None) -> DataFrame:
    """Prompts (session_id, seq) with ``shift``: True where a prompt starts a different task.

    It has four terms or more, three prompts before it, does not go on from what was said, and shares no
    term (as it is, or without its ending) with the six prompts before it or the 30 files touched last.
    ``prompts``: session_id, seq, text; ``files``: session_id, seq, path; ``synonyms``: term, alt.  Terms of a
    prompt are joined with the places where a term was last seen, so no set is carried along a session.
    """
    ranked = prompts.select("session_id", "seq", F.lit(1).alias("p"), F.lit(0).alias("f"), "text").unionByName(files.select("session_id", "seq", F.lit(0).alias("p"), F.lit(1).alias("f"), F.col("path").alias("text")))
    placed = with_carried(ranked, ["session_id"], ["seq", "f"], [running_sum("prompt_no", F.col("p")), running_sum("file_no", F.col("f"))], bucket)
    placed = written(placed, "events")
    name = F.regexp_replace(F.regexp_extract("text", "([^/]*)$", 1), r"\.[^.]+$", "")
    terms = F.when(F.col("p") == 1, query_terms(F.col("text"), stop, 20)).otherwise(query_terms(name, stop, 6))
    seen = placed.select("session_id", "seq", "p", "prompt_no", "file_no", F.explode(terms).alias("term"))
    known = seen
    if synonyms is not None:
        known = seen.unionByName(seen.join(synonyms, "term").withColumn("term", F.col("alt")).drop("alt"))
    asked = placed.where("p = 1").withColumn("terms", query_terms(F.col("text"), stop, 20))
    able = (F.size("terms") >= SHIFT_TERMS) & (F.col("prompt_no") > SHIFT_PROMPTS) & ~F.col("text").rlike(continues)
    able = asked.where(able).select("session_id", "seq", F.col("prompt_no").alias("n"), F.coalesce("file_no", F.lit(0)).alias("m"), F.explode("terms").alias("t"))
    forms = able.select("session_id", "seq", "n", "m", F.explode(F.array_distinct(F.array("t", F.regexp_replace("t", "(ing|ed|es|s)$", "")))).alias("term"))
    old = known.select("session_id", "term", "p", "prompt_no", "file_no", F.col("seq").alias("at"))
    met = forms.join(old, ["session_id", "term"]).where("at < seq")
    near = ((F.col("p") == 1) & (F.col("prompt_no") >= F.col("n") - RECENT_PROMPTS)) | ((F.col("p") == 0) & (F.col("file_no") > F.col("m") - RECENT_FILES))
    shared = met.where(near).select("session_id", "seq", F.lit(True).alias("shared")).distinct()
    shift = able.select("session_id", "seq").distinct().join(shared, ["session_id", "seq"], "left_anti").withColumn("shift", F.lit(True))
    return prompts.select("session_id", "seq").join(shift, ["session_id", "seq"], "left").select("session_id", "seq", F.coalesce("shift", F.lit(False)).alias("shift"))


def _listed(df: DataFrame, name: str, title: str, item: Column, order: Sequence[Column], most: int, newest: bool = False, bullet: str = "- ") -> DataFrame:
    """A block of the first (``newest``: last) ``most`` items of each session, read in order, under ``title``."""
    along = [o.desc() for o in order] if newest else list(order)
    nth = F.row_number().over(W.partitionBy("session_id").orderBy(*along))
    few = df.withColumn("nth", nth).where(F.col("nth") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("nth") if newest else F.col("nth")).alias("nth"), item.alias("s")))), lambda x: F.concat(F.lit(bullet), x["s"]))
    return few.groupBy("session_id").agg(F.array_join(lines, "\n").alias("s")).select("session_id", F.lit(name).alias("block"), F.concat(F.lit(title + "\n"), "s").alias("text"))


def _said(df: DataFrame, name: str, text: Column) -> DataFrame:
    return df.select("session_id", F.lit(name).alias("block"), text.alias("text"))


def handoff_blocks(prompts: DataFrame, replies: DataFrame, files: DataFrame, commands: DataFrame, facts: DataFrame, todos: DataFrame, checks: DataFrame, questions: DataFrame, stop: Sequence[str] = STOP, correction: str = CORRECTION) -> DataFrame:
    """(session_id, block, text): all blocks that a session has something for.

    prompts (session_id, seq, text), replies (the same), files (session_id, path, edits, reads), commands
    (session_id, seq, command: the ones worth telling), facts (session_id, seq, kind, text), todos
    (session_id, nth, status, text), checks (session_id, text), questions (session_id, question).

    The goal is the latest substantive prompt (not trivial, of 25 characters or more), or the last one.
    """
    told = F.coalesce(~is_trivial(F.col("text"), stop) & (F.char_length(F.trim("text")) >= SUBSTANTIVE), F.lit(False))
    asked = prompts.withColumn("real", told)
    ends = asked.groupBy("session_id").agg(
        F.max_by(F.struct("seq", "text"), F.struct("real", "seq")).alias("goal"), F.max_by(F.struct("seq", "text"), "seq").alias("latest"), F.min_by(F.struct("seq", "text", "real"), "seq").alias("first")
    )
    goal = ends.select("session_id", F.col("goal.seq").alias("goal_seq"), F.col("goal.text").alias("goal"), F.col("latest.seq").alias("latest_seq"), F.col("latest.text").alias("latest"), F.col("first.seq").alias("first_seq"), F.col("first.text").alias("first_text"), F.col("first.real").alias("first_real"))
    goal = written(goal, "goals")
    later = goal.where((F.col("latest_seq") != F.col("goal_seq")) & ~F.trim("latest").startswith("/"))
    spoken = replies.where(F.trim("text") != "")
    before = later.join(spoken.select("session_id", F.col("seq").alias("at"), F.col("text").alias("reply")), "session_id").where("at < latest_seq")
    before = before.groupBy("session_id").agg(F.max_by("reply", "at").alias("reply"))
    answer = F.when(F.col("reply").isNotNull(), F.concat(F.lit(" (replying to: "), one_line(F.reverse(F.substring(F.reverse(F.trim(squash(F.col("reply")))), 1, 240)), 240), F.lit(")"))).otherwise("")
    blocks = [
        _said(goal, "goal", F.concat(F.lit("Goal: "), one_line(F.col("goal"), 360))),
        _said(later.join(before, "session_id", "left"), "latest", F.concat(F.lit('Latest message: "'), one_line(F.col("latest"), 160), F.lit('"'), answer)),
        _said(questions, "question", F.concat(F.lit("Open question: "), one_line(F.col("question"), 260))),
        _said(checks, "check", F.col("text")),
        _said(goal.where((F.col("first_seq") != F.col("goal_seq")) & F.col("first_real")), "first", F.concat(F.lit("Started with: "), one_line(F.col("first_text"), 140))),
    ]
    # rules: what facts hold, then corrections among the last twelve prompts
    recent = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("seq").desc()))
    line = F.trim(F.get(F.split(F.trim("text"), "\n"), 0))
    wrong = prompts.withColumn("back", recent).where("back <= 12").withColumn("s", line).where(F.char_length("s").between(15, 200) & F.col("s").rlike(correction) & ~F.col("s").endswith("?"))
    rules = facts.where("kind = 'preference'").select("session_id", F.lit(0).alias("src"), "seq", F.col("text").alias("s")).unionByName(wrong.select("session_id", F.lit(1).alias("src"), "seq", F.concat(F.lit("User: "), "s").alias("s")))
    blocks.append(_listed(rules, "rules", "Rules:", one_line(F.col("s"), 180), [F.col("src"), F.col("seq"), F.col("s")], 5, newest=True))
    left = todos.where(F.coalesce(F.col("status") != "completed", F.lit(True)))
    blocks.append(_listed(left, "todos", "Open todos:", F.concat(F.lit("["), F.coalesce("status", F.lit("pending")), F.lit("] "), one_line(F.col("text"), 140)), [F.col("nth")], 10))
    since = spoken.join(goal.select("session_id", "goal_seq"), "session_id", "left").withColumn("after", F.coalesce(F.col("seq") >= F.col("goal_seq"), F.lit(True)))
    # replies since the goal if there are any, of these the substantial ones if there are any, else notes
    size = F.when(F.char_length(F.trim("text")) >= 160, 2).when(F.char_length(F.trim("text")) >= 30, 1).otherwise(0)
    graded = since.withColumn("grade", size).withColumn("best", F.max(F.struct("after", "grade")).over(W.partitionBy("session_id")))
    graded = graded.where((F.col("after") == F.col("best.after")) & (F.col("grade") >= F.col("best.grade")))
    graded = graded.withColumn("back", recent).where((F.col("back") <= 2) | ((F.col("back") == 3) & (F.col("grade") == 1)))
    blocks.append(_listed(graded, "replies", "Last replies:", F.when(F.col("back") == 1, one_line(F.col("text"), 700)).otherwise(one_line(F.col("text"), 350)), [F.col("seq")], 3, bullet="> "))
    blocks.append(_listed(facts.where("kind IN ('decision', 'cause')"), "decisions", "Decisions and causes:", one_line(F.col("text"), 200), [F.col("seq"), F.col("text")], 4, newest=True))
    blocks.append(_listed(files.where("edits > 0"), "changed", "Files changed:", F.col("path"), [-F.col("edits"), F.col("path")], 15))
    blocks.append(_listed(files.where("edits = 0 AND reads > 0"), "read", "Files read:", F.col("path"), [-F.col("reads"), F.col("path")], 12))
    earlier = asked.where("real").join(goal.select("session_id", "goal_seq"), "session_id").where("seq <> goal_seq")
    blocks.append(_listed(earlier, "requests", "Earlier requests:", one_line(F.col("text"), 200), [F.col("seq")], 3, newest=True))
    blocks.append(_listed(commands, "commands", "Recent commands:", F.col("command"), [F.col("seq")], 5, newest=True))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def build_handoff(blocks: DataFrame, tokens: int = HANDOFF_TOKENS, heading: str = "") -> DataFrame:
    """(session_id, text, tokens, n_blocks): the blocks that fit, taken by priority, shown in reading order.

    A block that does not fit is skipped and less important, smaller ones may still fit; ``heading`` counts
    against the budget and leads the text.
    """
    rank = F.create_map(*[F.lit(x) for b, (pri, at) in BLOCKS.items() for x in (b, pri * 100 + at)])
    place = F.create_map(*[F.lit(x) for b, (_, at) in BLOCKS.items() for x in (b, at)])
    costed = blocks.withColumns({"rank": F.element_at(rank, F.col("block")).cast("bigint"), "cost": token_estimate(F.concat("text", F.lit("\n")))})
    room = tokens - blocks.sparkSession.range(1).select(token_estimate(F.lit(heading)).alias("n")).first().n
    taken = budget_skip(costed, ["session_id"], "rank", "cost", room)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.element_at(place, F.col("block")).alias("at"), "text"))), lambda x: x["text"])
    head = F.lit(heading + "\n" if heading else "")
    out = taken.groupBy("session_id").agg(F.concat(head, F.array_join(lines, "\n")).alias("text"), F.sum("cost").alias("tokens"), F.count("*").alias("n_blocks"))
    return out
