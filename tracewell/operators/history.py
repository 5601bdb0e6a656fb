"""Search in the history of all sessions: live, archived and foreign ones together, with excerpts around the match."""

from __future__ import annotations

from functools import cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.text import squash, token_estimate
from tracewell.operators.search import bm25_rank, prompt_segments, wanted_counts
from tracewell.operators.upkeep import days_since
from tracewell.session import written

# --- fixed values ---
WHO_WEIGHT = {"you": 1.35, "Claude": 1.0, "tool result": 0.6}
OTHER_WEIGHT, DECISION_WEIGHT, FRESH_WEIGHT, FRESH_DAYS, UNKNOWN_DAYS = 0.5, 1.25, 0.15, 7, 30
DECISION = r"(?i)\b(decided|decision|we chose|chose to|going with|settled on|root cause|caused by|the fix|fixed by|because|workaround|must not|never|always|convention)\b"
EXCERPT_CHARS, KEY_CHARS, RESULTS, SEARCH_TOKENS, HEADING_TOKENS = 600, 120, 10, 2500, 30
_BASE, _LONG = 0x9E3779B97F4A7C15, 1 << 20


def deep_union(live: DataFrame, archived: DataFrame, *foreign: DataFrame) -> DataFrame:
    """All items with their ``origin``: live ones, archived ones of sessions that are no longer live, foreign ones.

    Columns that one side lacks are null there.  Items without a session are kept on every side.
    """
    gone = archived.join(live.select("session_id").distinct(), "session_id", "left_anti")
    out = live.withColumn("origin", F.lit("live")).unionByName(gone.withColumn("origin", F.lit("archive")), allowMissingColumns=True)
    for f in foreign:
        out = out.unionByName(f.withColumn("origin", F.lit("foreign")), allowMissingColumns=True)
    return out


def item_weight(as_of: Column, who: str = "who", text: str = "text", ts: str = "ts", decision: str = DECISION) -> Column:
    """What an item counts for: who said it, whether it states a decision (results of tools do not), how fresh it is."""
    w = F.lit(OTHER_WEIGHT)
    for name, value in WHO_WEIGHT.items():
        w = F.when(F.col(who) == name, F.lit(value)).otherwise(w)
    states = F.when((F.coalesce(who, F.lit("")) != "tool result") & F.col(text).rlike(decision), F.lit(DECISION_WEIGHT)).otherwise(F.lit(1.0))
    age = F.coalesce(F.greatest(F.lit(0.0), days_since(as_of, F.col(ts))), F.lit(float(UNKNOWN_DAYS)))
    return w * states * (1 + FRESH_WEIGHT * F.exp(-age / FRESH_DAYS))


def ago(as_of: Column, ts: Column) -> Column:
    m = F.round(F.timestamp_diff("SECOND", ts, as_of) / 60)
    said = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(f"{unit} ago"))
    return F.when(ts.isNull(), "?").when(m < 60, said(F.greatest(F.lit(1), m), "m")).when(m < 2880, said(F.round(m / 60), "h")).otherwise(said(F.round(m / 1440), "d"))


def excerpt(text: Column, pos: Column, chars: int = EXCERPT_CHARS) -> Column:
    """``chars`` characters of the text from a third of them before ``pos`` (from 0), on one line, with marks where it goes on."""
    start = F.greatest(F.lit(0), pos - round(chars / 3)).cast("int")
    body = F.trim(squash(F.substring(text, start + 1, F.lit(chars))))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + chars < F.length(text), "…").otherwise(""))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power = lambda base: np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
    return power(_BASE), power(pow(_BASE, -1, 1 << 64))


def excerpt_marks(text: str, places: list, chars: int = EXCERPT_CHARS) -> np.ndarray:
    """Numbers that excerpts with equal first ``KEY_CHARS`` characters share; others may share them, too.

    No two blanks follow each other there, so at least half of these characters are none.  The first that are
    none make the mark, as a polynomial whose sums are taken once for a text.
    """
    third = round(chars / 3)
    start = np.maximum(0, np.asarray(places, np.int64) - third)
    if len(text) > _LONG and len(places) > 0:  # each excerpt by itself, with a character on either side if there is one
        return np.concatenate([excerpt_marks(text[max(0, s - 1) : s + chars + 1], [min(s, 1) * (third + 1)], chars) for s in start.tolist()])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    solid = (code != 32) & ((code < 9) | (code > 13))
    before = np.append(0, np.cumsum(solid))
    power, back = _powers(1 << (KEY_CHARS + len(code)).bit_length())
    sums = np.append(np.uint64(0), np.cumsum(code[solid] * power[: before[-1]]))
    first, cut, open_ = before[np.minimum(start, len(code))], (start > 0).astype(np.int64), start + chars < len(code)
    n = np.minimum(before[np.minimum(start + chars, len(code))] - first, KEY_CHARS // 2 - cut)
    mark = (sums[first + n] - sums[first]) * back[first]
    mark = np.where(cut, mark * power[1] + np.uint64(ord("…")), mark)
    ends = open_ & (cut + n < KEY_CHARS // 2)
    mark = mark + np.where(ends, power[cut + n] * np.uint64(ord("…")), np.uint64(0))
    return (mark >> np.uint64(32)).astype(np.uint32).view(np.int32)


def history_search(items: DataFrame, queries: DataFrame, as_of: Column, tokens: int = SEARCH_TOKENS, most: int = RESULTS, chars: int = EXCERPT_CHARS, decision: str = DECISION) -> DataFrame:
    """(query_id, rank, item_id, session_id, score, line): what earlier sessions say about each query, best first.

    ``items``: item_id, session_id, who, ts, text (one row an id; null text matches nothing); ``queries``:
    query_id, text.  Of items whose excerpts begin alike the best one stays, ties to the smaller id; then the
    first ``most`` as far as their lines fit ``tokens``.  Each task keeps what can be among these, by marks of
    the excerpts; only that meets the keys of excerpts, and texts are joined again for it.
    """
    weighed = items.select("item_id", "text", item_weight(as_of, decision=decision).alias("weight"))
    segments = prompt_segments(queries, "query_id")
    counts = wanted_counts(weighed, segments, "item_id", "query_id", weight="weight", marks=partial(excerpt_marks, chars=chars))
    best = bm25_rank(weighed, segments, "item_id", "query_id", weight="weight", counts=counts, best=True, most=most, apart=True)
    best = written(best.select("query_id", "item_id", F.round("score", 6).alias("score"), "pos"), "best")
    # queries share places of a text: each place's excerpt is made once, and a text read once for all its places
    spots = best.groupBy("item_id").agg(F.collect_set("pos").alias("spots")).join(items.select("item_id", "text"), "item_id")
    begins = lambda pos: F.struct(pos.alias("pos"), F.substring(excerpt(F.col("text"), pos, chars), 1, KEY_CHARS).alias("key"))
    spots = spots.select("item_id", F.transform("spots", begins).alias("spots")).select("item_id", F.inline("spots"))
    keyed = best.join(spots, ["item_id", "pos"])
    first = F.min(F.struct((-F.col("score")).alias("minus"), "item_id", "pos")).alias("b")
    once = keyed.groupBy("query_id", "key").agg(first)
    place = W.partitionBy("query_id").orderBy("b.minus", "b.item_id")
    top = written(once.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most), "top")
    shown = top.select("query_id", "rank", "b.item_id", (-F.col("b.minus")).alias("score"), "b.pos").join(items.select("item_id", "session_id", "who", "ts", "text"), "item_id")
    line = F.concat(F.lit("- "), ago(as_of, F.col("ts")), F.lit(" · "), F.coalesce("who", F.lit("?")), F.lit(": "), excerpt(F.col("text"), F.col("pos"), chars))
    shown = shown.withColumn("line", line)
    used = F.sum(token_estimate(F.col("line")) + 1).over(W.partitionBy("query_id").orderBy("rank"))
    return shown.withColumn("used", used + HEADING_TOKENS).where(F.col("used") <= tokens).select("query_id", "rank", "item_id", "session_id", "score", "line")
