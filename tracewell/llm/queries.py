"""The registered queries of the training-data operators, each over its whole table, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, chat, html_consensus, line_dedup, mixing, multi_index, multiprobe, ngram_join, pseudo_likelihood, spelling, suffix_family, toxicity, whitening

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql.strip()
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn ', '\o'), '</turn>', '\c') AS esc FROM t
), c AS (
  SELECT *, sum(length(esc) + length(role) + 16) OVER w AS upto, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, esc)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM c GROUP BY conv_id
"""


@query("op1_chat_prefix_targets", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    hard = hard.select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    return chat.digest_examples(chat.prefix_targets(turns.union(hard)))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
  SELECT *, CAST(nth % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / (nth % 3 + 1) AS ratio FROM s
), l AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM w) - coalesce(sum(most) OVER p, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, least(most, coalesce((SELECT max(level) FROM l WHERE ratio > level) * weight, most)) AS target FROM l
), o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CAST(sum(d.size) OVER (PARTITION BY g.nth ORDER BY d.key, d.doc_id) AS BIGINT) - d.size AS o
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(size, greatest(0, least(source_size, floor(target))) - o))
  + greatest(0, least(size, greatest(0, least(source_size, floor(target) - source_size)) - o))
  + greatest(0, least(size, greatest(0, least(source_size, floor(target) - 2 * source_size)) - o)) AS BIGINT) AS taken
FROM o
"""


@query("op4_mix_splitting_tree", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, segments = mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    taken = segments.groupBy("nth", "slice", "rn").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return rows.join(taken, ["nth", "slice", "rn"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last_id IS NOT NULL AND doc_id <> last_id) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN last_id IS NULL OR doc_id = last_id THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""


@query("op6_line_dedup_bitmaps", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_bpe_distinct_words")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_toxicity_noisy_or")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


@query("op7_html_host_consensus")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract_main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


@query("op2_multiprobe_nearest", NEAREST_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return multiprobe.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op10_multi_index_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_copies(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query("op9_masked_pseudo_likelihood")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return pseudo_likelihood.train_and_score(docs)


REPEATS_SQL = """
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM t)
), d AS (
  SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1
), g AS (
  SELECT r, i, coalesce(i - lag(i) OVER w > 200, true) AS fresh FROM d WINDOW w AS (PARTITION BY r ORDER BY i)
), n AS (
  SELECT r, i, count(*) FILTER (fresh) OVER (PARTITION BY r ORDER BY i) AS nth FROM g
), c AS (
  SELECT r, nth, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY ALL
), e AS (
  SELECT *, coalesce(lag(z) OVER w, 0) AS before, row_number() OVER (PARTITION BY r ORDER BY a DESC) = 1 AS last FROM c WINDOW w AS (PARTITION BY r ORDER BY a)
), k AS (
  SELECT r, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || max(CASE WHEN last THEN substr(h, 2 * z + 1) ELSE '' END) AS kept
  FROM e JOIN t USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN k USING (r)
"""


@query("op11_suffix_family_dedup", REPEATS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_family.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_block_matrix_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


# words meet by what is left without one code point; only substitutions keep the length
SPELLING_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps
), r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), d AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM r WHERE length(run) >= 6 GROUP BY ALL
), b AS (
  SELECT run, times, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM d
), c AS (
  SELECT run, times, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, crc
), w AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n
  FROM c GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5
), gaps AS (
  SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN w b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(struct_pack(other, m, n), struct_pack(x := -m, y := other)) AS o FROM near GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN o.m >= 5 * o.n THEN o.other END AS form, CASE WHEN o.m >= 5 * o.n THEN o.m END AS form_n FROM w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, n_near, form, form_n, root FROM f JOIN (SELECT walk.word, root FROM walk JOIN f ON f.word = root WHERE f.form IS NULL) USING (word)
"""


@query("op13_spelling_q_chunks", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents", "doc_id", "text"))
