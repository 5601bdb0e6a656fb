"""Durable facts that a session states: preferences, causes, decisions and commands that work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.ordered import last_value, with_carried
from tracewell.operators.similar import first_similar, word_set
from tracewell.session import written


@dataclass(frozen=True)
class FactRules:
    """Patterns and limits; the defaults are fixed values."""

    decision: str = r"(?i)\b(decided|decision:|we chose|chose to|opted (?:for|to)|settled on|going with|we(?:'ll| will) (?:use|keep|go with)|convention is|agreed to)\b"
    cause: str = r"(?i)\b(root cause|caused by|the (?:bug|issue|problem|error|failure|crash) (?:was|is|comes from)|(?:fails|failed|failing|broke|breaks) because|happens because|the fix (?:was|is)|fixed (?:it )?by)\b"
    plain_cause: str = r"(?i)root cause"
    preference: str = r"(?i)^(?:please\s+)?(?:always|never|don't|do not|stop|avoid|prefer|i prefer|i'd prefer|i want you to|i'd like you to|from now on|make sure (?:to|you)|no more)\b|\bfrom now on\b"
    standing: str = r"(?i)^(?:User preference:\s*)?(?:please\s+)?(?:always|never|from now on|don'?t|do not|no more|stop|make sure (?:to|you)|prefer)\b"
    command: str = (
        r"^(?:(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?(?:test|build|lint|typecheck|check|dev|start|e2e|format|migrate|deploy|release)\b|npx\s+(?:vitest|jest|tsc|eslint|playwright|prisma|drizzle-kit)\b|"
        r"(?:pytest|tox|ruff|mypy|cargo\s+(?:test|build|clippy|run)|go\s+(?:test|build|vet|run)|make\b|just\b|gradle|\./gradlew|mvn|dotnet\s+(?:test|build)|bundle exec|rake|mix\s+test|docker\s+compose|"
        r"docker-compose|terraform\s+(?:plan|apply)|fly\s+deploy|vercel|uv\s+run|poetry\s+run|python3?\s+-m\s+(?:pytest|unittest)))"
    )
    failed: str = r"\b(exit code [1-9]|command failed|npm ERR!|FAILED|Traceback \(most recent)"
    secret: str = r"(?i)(sk-[a-z0-9-]{8,}|ghp_[A-Za-z0-9]{10,}|xox[abp]-|AKIA[0-9A-Z]{12,}|Bearer\s+[A-Za-z0-9._-]{10,}|(?:api[_-]?key|token|secret|password|passwd)\s*[=:]\s*\S+)"
    noise: str = r"^\s*(<system-reminder>|<command-|<local-command|Caveat:)"
    remember: str = r"(?i)^\s*remember\b"
    narration: str = r"(?i)^(let me|i'll|i will|i'm going to|now i|next,? i|first,? i|okay|ok,|sure|great|done)"
    #: Entries after a failed command in which a cause counts.
    near: int = 12
    similar: float = 0.6
    #: Newest (commands: first) facts of a kind that stay, in the order of the answer, and of all kinds.
    caps: tuple[tuple[str, int], ...] = (("preference", 2), ("cause", 3), ("decision", 3), ("command", 2))
    most: int = 8


def quoted_only(sentence: Column, trigger: str) -> Column:
    """True if the sentence holds the trigger, and each time inside double quotes: after an odd number of them."""
    # what lies between two triggers has the quotes that precede the second
    parts = F.split(F.regexp_replace(sentence, r"^Root cause:\s*", ""), trigger, -1)
    quotes = F.transform(parts, lambda p: F.char_length(F.regexp_replace(p, '[^"“”]', "")))
    odd = lambda i: F.aggregate(F.slice(quotes, F.lit(1), i), F.lit(0), lambda n, q: n + q) % 2 == 1
    return (F.size(parts) > 1) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), odd)


def sentences(text: Column, secret: str, least: int = 25, most: int = 240) -> Column:
    """Sentences of a text without code blocks, of ``least`` to ``most`` characters, no questions or secrets."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), "`", "")
    parts = F.transform(F.split(clean, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^[\s\-*#>\d.)]+", ""), r"\*\*", "")))
    return F.filter(parts, lambda s: F.char_length(s).between(least, most) & ~s.endswith("?") & ~s.rlike(secret))


def commands_run(blocks: DataFrame, rules: FactRules = FactRules()) -> DataFrame:
    """(session_id, seq, block, command, failed): project commands at the place of their first result."""
    cmd = F.trim(F.regexp_replace("command", r"^\s*cd\s+[^&;]+&&\s*", ""))
    calls = blocks.where("block_type = 'tool_use' AND tool = 'Bash'").select("session_id", F.col("tool_id").alias("id"), F.col("seq").alias("at"), cmd.alias("command"))
    calls = calls.where((F.char_length("command") <= 120) & ~F.contains("command", F.lit("\n")) & F.col("command").rlike(rules.command) & ~F.col("command").rlike(rules.secret))
    results = blocks.where("block_type = 'tool_result'").select("session_id", F.col("result_id").alias("id"), "seq", "block", (F.coalesce("is_error", F.lit(False)) | F.coalesce(F.col("result").rlike(rules.failed), F.lit(False))).alias("failed"))
    met = calls.join(results, ["session_id", "id"]).where("seq > at")
    first = met.groupBy("session_id", "id", "at", "command").agg(F.min(F.struct("seq", "block", "failed")).alias("r"))
    return first.select("session_id", "r.seq", "r.block", "command", "r.failed")


def stated(blocks: DataFrame, runs: DataFrame, rules: FactRules, bucket: Column) -> DataFrame:
    """(session_id, kind, seq, block, nth, text) of all preferences, causes and decisions, repeated ones too."""
    plain = blocks.where((F.col("block_type") == "text") & ~F.col("text").rlike(rules.noise))
    user = plain.where((F.col("type") == "user") & ~F.col("text").rlike(rules.remember))
    lines = user.select("session_id", "seq", "block", F.posexplode(F.split("text", r"\n+")).alias("nth", "s")).withColumn("s", F.trim("s"))
    wishes = lines.where(F.char_length("s").between(15, 200) & F.col("s").rlike(rules.preference) & ~F.col("s").endswith("?") & ~F.col("s").rlike(rules.secret))
    wishes = wishes.select("session_id", F.lit("preference").alias("kind"), "seq", "block", "nth", F.concat(F.lit("User preference: "), "s").alias("text"))

    # the place of the last failure is carried along the session, past it only
    marks = plain.where("type = 'assistant'").select("session_id", "seq", "block", "text", F.lit(None).cast("bigint").alias("fail"))
    fails = runs.where("failed").select("session_id", "seq", "block", F.lit(None).cast("string").alias("text"), F.col("seq").cast("bigint").alias("fail"))
    said = with_carried(marks.unionByName(fails), ["session_id"], ["seq", "block"], [last_value("last_fail", F.col("fail"))], bucket).where("text IS NOT NULL")
    said = said.select("session_id", "seq", "block", "last_fail", F.posexplode(sentences(F.col("text"), rules.secret)).alias("nth", "s"))
    said = said.where(~F.col("s").rlike(rules.narration) & ~quoted_only(F.col("s"), rules.cause) & ~quoted_only(F.col("s"), rules.decision))
    after = F.coalesce(F.col("seq") - F.col("last_fail") <= rules.near, F.lit(False))
    kind = F.when(F.col("s").rlike(rules.cause) & (after | F.col("s").rlike(rules.plain_cause)), "cause").when(F.col("s").rlike(rules.decision), "decision")
    labelled = F.when(F.col("s").rlike("(?i)^root cause"), F.col("s")).otherwise(F.concat(F.lit("Root cause: "), "s"))
    said = said.withColumn("kind", kind).where("kind IS NOT NULL")
    return wishes.unionByName(said.select("session_id", "kind", "seq", "block", "nth", F.when(F.col("kind") == "cause", labelled).otherwise(F.col("s")).alias("text")))


def extract_facts(blocks: DataFrame, rules: FactRules = FactRules(), bucket: Column | None = None) -> DataFrame:
    """(session_id, rank, kind, text, seq, standing) of ``blocks`` (session_id, seq, block, type, block_type, text,
    tool, tool_id, command, result_id, is_error, result; main chain, ``seq`` the entry's place).

    Within a kind a text like an earlier one goes.  The newest of each kind stay, commands that failed before
    they passed come first, the latest of these before the others.  ``standing`` marks preferences that hold
    from now on.  ``bucket`` must not decrease along ``seq``; by default 1,000 entries.
    """
    runs = written(commands_run(blocks, rules), "runs")
    bucket = F.floor(F.col("seq") / 1000) if bucket is None else bucket
    order = F.struct("seq", "block", "nth")
    facts = stated(blocks, runs, rules, bucket).select("session_id", "kind", order.alias("id"), "text", F.lit(False).alias("fixed"))
    failed = runs.where("failed").groupBy("session_id", "command").agg(F.min(F.struct("seq", "block")).alias("failed_at"))
    passed = runs.where("NOT failed").join(failed, ["session_id", "command"], "left")
    # of equal commands the first that passed says whether it had failed before
    fixed = F.coalesce(F.col("failed_at") < F.struct("seq", "block"), F.lit(False))
    passed = passed.select("session_id", F.lit("command").alias("kind"), F.struct(F.col("seq"), F.col("block"), F.lit(0).alias("nth")).alias("id"), F.concat(F.lit("Command that works here: `"), "command", F.lit("`")).alias("text"), fixed.alias("fixed"))
    facts = facts.unionByName(passed)
    kept = first_similar(facts.select("session_id", "kind", "id", word_set(F.col("text")).alias("words")), ["session_id", "kind"], rules.similar)
    facts = facts.join(kept.where(F.col("id") == F.col("first")).select("session_id", "kind", "id"), ["session_id", "kind", "id"])

    caps = F.create_map(*[F.lit(x) for kind, cap in rules.caps for x in (kind, cap)])
    place = F.create_map(*[F.lit(x) for i, (kind, _) in enumerate(rules.caps) for x in (kind, i)])
    command = F.col("kind") == "command"
    of_kind = W.partitionBy("session_id", "kind")
    # commands: fixed ones, latest first, then the others in order; other kinds: the newest
    plain = F.when(command & ~F.col("fixed"), F.col("id"))
    nth = F.row_number().over(of_kind.orderBy(F.col("fixed").desc(), plain.asc_nulls_last(), F.col("id").desc()))
    facts = facts.withColumn("nth", nth).where(F.col("nth") <= F.element_at(caps, F.col("kind")))
    along = F.when(command, F.col("nth")).otherwise(-F.col("nth"))
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.element_at(place, F.col("kind")), along))
    standing = (F.col("kind") == "preference") & F.col("text").rlike(rules.standing) & (F.char_length("text") >= 25)
    return facts.withColumn("rank", rank).where(F.col("rank") <= rules.most).select("session_id", "rank", "kind", "text", "id.seq", standing.alias("standing"))

