"""Facts that the conversations state; each assistant turn also runs a command whose result comes with the next turn."""

from pyspark.sql import functions as F

from tracewell.operators import facts as X
from tracewell.plans.oracle import lit
from tracewell.plans.registry import query, table
from tracewell.sources.bindings import COMMANDS

# words of the invented prose stand for the English of the default rules; causes count right after a failure
RULES = X.FactRules(
    decision=r"(^| )(with|une|und)[ ,]", cause=r"(^| )(that|les|die)[ ,]", plain_cause=r"(^| )that [a-f]", preference=r"^(Is|The|Es|Le|An)[a-z]* ", standing=r"^User preference: The",
    narration=r"^(Et|In)", noise=r"^Re", remember=r"^Th", near=1,
)

CANDIDATES = f"""cmds(i, command) AS (VALUES {", ".join(f"({i}, {lit(c[0])})" for i, c in enumerate(COMMANDS))}),
u AS (SELECT conv_id AS s, turn, regexp_replace(command, '^\\s*cd\\s+[^&;]+&&\\s*', '') AS command, (conv_id + turn) % 3 = 0 AS failed
  FROM conversations JOIN cmds ON i = (conv_id + turn) % {len(COMMANDS)} WHERE role = 'assistant' AND (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM conversations WHERE role = 'user')),
runs AS (SELECT s, turn + 1 AS seq, command, failed FROM u WHERE regexp_matches(command, '{RULES.command}') AND NOT regexp_matches(command, '{RULES.secret}')),
w AS (SELECT s, 'preference' AS kind, seq, nth, 'User preference: ' || x AS text, false AS fixed FROM (
  SELECT conv_id AS s, turn AS seq, trim(unnest(string_split_regex(text, '\\n+'))) AS x, generate_subscripts(string_split_regex(text, '\\n+'), 1) AS nth
  FROM conversations WHERE role = 'user' AND NOT regexp_matches(text, '{RULES.noise}') AND NOT regexp_matches(text, '{RULES.remember}')
) WHERE length(x) BETWEEN 15 AND 200 AND regexp_matches(x, '{RULES.preference}') AND x NOT LIKE '%?'),
p AS (SELECT conv_id AS s, turn AS seq, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS parts FROM conversations WHERE role = 'assistant' AND NOT regexp_matches(text, '{RULES.noise}')),
q AS (SELECT * FROM (SELECT s, seq, generate_subscripts(parts, 1) AS nth, trim(regexp_replace(unnest(parts), '^[\\s\\-*#>\\d.)]+', '')) AS x FROM p) WHERE length(x) BETWEEN 25 AND 240 AND x NOT LIKE '%?' AND NOT regexp_matches(x, '{RULES.narration}')),
a AS (SELECT s, seq, nth, x, coalesce(seq - (SELECT max(r.seq) FROM runs r WHERE r.s = q.s AND r.failed AND r.seq < q.seq) <= {RULES.near}, false) AS after FROM q),
k AS (SELECT *, CASE WHEN regexp_matches(x, '{RULES.cause}') AND (after OR regexp_matches(x, '{RULES.plain_cause}')) THEN 'cause' WHEN regexp_matches(x, '{RULES.decision}') THEN 'decision' END AS kind FROM a),
c AS (SELECT s, kind, seq, nth, CASE kind WHEN 'cause' THEN 'Root cause: ' || x ELSE x END AS text, false AS fixed FROM k WHERE kind IS NOT NULL
  UNION ALL FROM w
  UNION ALL SELECT s, 'command', seq, 0, 'Command that works here: `' || command || '`', EXISTS (FROM runs f WHERE f.s = r.s AND f.command = r.command AND f.failed AND f.seq < r.seq) FROM runs r WHERE NOT failed),
n AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws, row_number() OVER (PARTITION BY s, kind ORDER BY seq, nth) AS i FROM c),
f(s, kind, i, keep, kept) AS (
  SELECT s, kind, 0::BIGINT, false, []::VARCHAR[][] FROM n WHERE i = 1
  UNION ALL SELECT n.s, n.kind, n.i, g.fresh, CASE WHEN g.fresh THEN list_append(f.kept, n.ws) ELSE f.kept END
  FROM f JOIN n ON n.s = f.s AND n.kind = f.kind AND n.i = f.i + 1, LATERAL (SELECT len(list_filter(f.kept, lambda o: len(list_intersect(o, n.ws)) >= 0.6::DOUBLE * (len(o) + len(n.ws) - len(list_intersect(o, n.ws))))) = 0 AS fresh) g)"""


def blocks(spark, d):
    """Conversations as content blocks (see the module's docstring)."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("type"), "text")
    commands = F.array(*[F.lit(c[0]) for c in COMMANDS])
    command = F.get(commands, ((F.col("session_id") + F.col("seq")) % len(COMMANDS)).cast("int"))
    none = F.lit(None).cast("string")
    text = F.struct(F.lit(0).alias("block"), F.lit("text").alias("block_type"), F.col("text"), none.alias("tool"), none.alias("tool_id"), none.alias("command"), none.alias("result_id"), F.lit(False).alias("is_error"), none.alias("result"))
    call = F.struct(F.lit(1).alias("block"), F.lit("tool_use").alias("block_type"), none.alias("text"), F.lit("Bash").alias("tool"), F.col("seq").cast("string").alias("tool_id"), command.alias("command"), none.alias("result_id"), F.lit(False).alias("is_error"), none.alias("result"))
    failed = (F.col("session_id") + F.col("seq") - 1) % 3 == 0
    result = F.struct(F.lit(1).alias("block"), F.lit("tool_result").alias("block_type"), none.alias("text"), none.alias("tool"), none.alias("tool_id"), none.alias("command"), (F.col("seq") - 1).cast("string").alias("result_id"), failed.alias("is_error"), F.lit("ok").alias("result"))
    all_ = F.when(F.col("type") == "assistant", F.array(text, call)).when(F.col("type") == "user", F.array(text, result)).otherwise(F.array(text))
    return turns.select("session_id", "seq", "type", F.inline(all_))


@query(
    "facts_extract",
    f"""WITH RECURSIVE {CANDIDATES},
r AS (SELECT n.*, row_number() OVER (PARTITION BY s, kind ORDER BY fixed DESC, CASE WHEN kind = 'command' AND NOT fixed THEN seq END, seq DESC, nth DESC) AS nth_ FROM f JOIN n USING (s, kind, i) WHERE keep),
t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY list_position(['preference', 'cause', 'decision', 'command'], kind), CASE kind WHEN 'command' THEN nth_ ELSE -nth_ END) AS rank
  FROM r WHERE nth_ <= CASE kind WHEN 'preference' THEN 2 WHEN 'command' THEN 2 ELSE 3 END)
SELECT s AS session_id, rank, kind, text, seq, kind = 'preference' AND regexp_matches(text, '{RULES.standing}') AND length(text) >= 25 AS standing FROM t WHERE rank <= 8""",
)
def facts_extract(spark, d):
    return X.extract_facts(blocks(spark, d), RULES, bucket=F.floor(F.col("seq") / 2))
