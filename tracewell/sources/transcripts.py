"""Session transcripts and buffers: JSONL files to entries, blocks and history items.

A line is parsed once into a VARIANT; columns are cut from it, and lines that are no entry are counted and
kept apart.  Files split like any text, so one long transcript is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.corpus import scrub_private

#: <session>.jsonl, and <session>/subagents/<any>.jsonl of the agents that it launched.
SESSION_FILE = r"([^/]+?)(?:/subagents/[^/]+)?\.jsonl$"
SUBAGENT_FILE = r"/subagents/[^/]+$"
#: Texts of fewer characters are not worth keeping.
MIN_ITEM_CHARS = 12
# --- fixed values: how text begins that the client puts into a session; marks of own tools come by ``noise`` ---
NOISE = r"^\s*(<system-reminder>|<command-(name|message|args)>|<local-command-stdout>|Caveat: The messages below)"

#: Columns of an entry and where they lie in a line.
ENTRY = {
    "type": ("$.type", "string"),
    "timestamp": ("$.timestamp", "string"),
    "cwd": ("$.cwd", "string"),
    "is_sidechain": ("$.isSidechain", "boolean"),
    "is_meta": ("$.isMeta", "boolean"),
    "is_summary": ("$.isCompactSummary", "boolean"),
    "subtype": ("$.subtype", "string"),
    "msg_id": ("$.message.id", "string"),
    "role": ("$.message.role", "string"),
    "model": ("$.message.model", "string"),
    "input_tokens": ("$.message.usage.input_tokens", "bigint"),
    "output_tokens": ("$.message.usage.output_tokens", "bigint"),
    "cache_read": ("$.message.usage.cache_read_input_tokens", "bigint"),
    "cache_creation": ("$.message.usage.cache_creation_input_tokens", "bigint"),
    "cache_1h": ("$.message.usage.cache_creation.ephemeral_1h_input_tokens", "bigint"),
    "content": ("$.message.content", "variant"),
}
BUFFER = (
    "seq bigint, ts timestamp, t string, cwd string, text string, path string, op string, ranged boolean, cmd string, key string, keys array<string>, "
    "ids array<string>, files array<string>, k string, level int, tokens bigint, mtime bigint, size bigint, ok boolean, sig string, fp string, "
    "items array<struct<kind: string, text: string, ts: timestamp>>, name string, ro boolean"
)


def read_lines(spark: SparkSession, path: str, modified_after: str | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """(value, file, modified): lines of all files below ``path`` named like ``pattern``, of those changed after
    ``modified_after`` (a timestamp in the session's time zone) if it is given; other files are not opened."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def read_collected(spark: SparkSession, path: str, modified_after: str | None = None, pattern: str = "*.json") -> DataFrame:
    """As ``read_lines``, of transcripts that a collector has put together: each line of ``path`` is an object with
    the ``line`` as it was and the ``file`` that it is from, so many sessions share a file."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema("file string, line string")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.json(path).select(F.col("line").alias("value"), "file", F.col("_metadata.file_modification_time").alias("modified"))


def parse_lines(lines: DataFrame, session: str = SESSION_FILE, subagent: str = SUBAGENT_FILE) -> DataFrame:
    """``lines`` (value, file) with session_id, is_subagent, ``line_kind`` (entry, blank, other, torn) and ``json``.

    ``other`` does not begin with a brace; ``torn`` does and can't be parsed, as a line half written.
    """
    df = lines.withColumn("json", F.when(F.col("value").startswith("{"), F.try_parse_json("value")))
    kind = F.when(F.col("json").isNotNull(), "entry").when(F.trim("value") == "", "blank").when(F.col("value").startswith("{"), "torn").otherwise("other")
    where = {"session_id": F.regexp_extract("file", session, 1), "is_subagent": F.col("file").rlike(subagent)}
    return df.withColumns({**where, "line_kind": kind})


def entries(parsed: DataFrame) -> DataFrame:
    """Entries of parsed lines, with the columns of ``ENTRY`` and ``ts``; what a line lacks is null."""
    cut = {name: F.try_variant_get("json", path, kind) for name, (path, kind) in ENTRY.items()}
    out = parsed.where("line_kind = 'entry'").withColumns(cut)
    return out.withColumn("ts", F.try_to_timestamp("timestamp")).drop("json", "value", "line_kind", "timestamp")


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines that are no entry: (session_id, file, line_kind, value)."""
    return parsed.where("line_kind <> 'entry'").select("session_id", "file", "line_kind", "value")


def read_transcripts(spark: SparkSession, path: str, modified_after: str | None = None, pattern: str = "*.jsonl", session: str = SESSION_FILE, subagent: str = SUBAGENT_FILE, collected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries of all transcripts below ``path``, and the lines that are none; ``collected`` ones by ``read_collected``."""
    read = read_collected if collected else read_lines
    parsed = parse_lines(read(spark, path, modified_after, pattern), session, subagent)
    return entries(parsed), rejected(parsed)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def explode_blocks(items: DataFrame) -> DataFrame:
    """One row per content block of ``items`` (a column ``content``), with its place ``block`` from 0.

    A content that is a string is one block of type text.  Columns: type, text, thinking, tool, tool_id and
    input of a call, result_id, is_error and result of a result (its text blocks, a line each).  An entry
    without content has no row; blocks that are null are left out, the places of the others stay.
    """
    content = F.col("content")
    several = F.when(_is(content, "ARRAY"), _get(content, "$", "array<variant>")).when(_is(content, "STRING"), F.array(content))
    df = items.select(*[c for c in items.columns if c != "content"], F.posexplode(several).alias("block", "__b"))
    b = F.col("__b")
    plain = _is(b, "STRING")
    kind = F.when(plain, F.lit("text")).otherwise(_get(b, "$.type"))
    df = df.where(b.isNotNull() & ~_is(b, "VOID")).withColumn("block_type", kind)
    is_ = lambda name: F.col("block_type") == name
    inner = _get(b, "$.content", "variant")
    parts = F.filter(_get(inner, "$", "array<variant>"), lambda x: _get(x, "$.type") == "text")
    joined = F.array_join(F.transform(parts, lambda x: _get(x, "$.text")), "\n")
    result = F.when(_is(inner, "STRING"), _get(inner, "$")).when(_is(inner, "ARRAY"), joined)
    return df.withColumns(
        {
            "text": F.when(plain, _get(b, "$")).when(is_("text"), _get(b, "$.text")),
            "thinking": F.when(is_("thinking"), _get(b, "$.thinking")),
            "tool": F.when(is_("tool_use"), _get(b, "$.name")),
            "tool_id": F.when(is_("tool_use"), _get(b, "$.id")),
            "input": F.when(is_("tool_use"), F.coalesce(F.to_json(_get(b, "$.input", "variant")), F.lit("{}"))),
            "result_id": F.when(is_("tool_result"), _get(b, "$.tool_use_id")),
            "is_error": F.when(is_("tool_result"), F.coalesce(_get(b, "$.is_error", "boolean"), F.lit(False))),
            "result": F.when(is_("tool_result"), F.coalesce(result, F.lit(""))),
        }
    ).drop("__b")


def to_history_items(blocks: DataFrame, noise: str = NOISE, max_text: int | None = None, max_tool: int | None = None) -> DataFrame:
    """``blocks`` worth searching, with ``who`` says it and the scrubbed ``item``.

    Main-chain texts, calls (their input) and results of users and assistants, of at least 12 characters,
    not noise.  Of longer ones the first ``max_text`` (``max_tool``) characters if a number is given.
    """
    kind, user = F.col("block_type"), F.col("type") == "user"
    speaker = F.when(user, "you").otherwise("Claude")
    who = F.when(kind == "text", speaker).when(kind == "tool_use", F.concat(F.lit("Claude → "), "tool")).when(kind == "tool_result", "tool result")
    item = F.when(kind == "text", F.col("text")).when(kind == "tool_use", F.col("input")).when(kind == "tool_result", F.col("result"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    df = blocks.where(F.col("type").isin("user", "assistant") & no("is_sidechain") & no("is_meta")).withColumns({"who": who, "item": item})
    df = df.where((F.char_length("item") >= MIN_ITEM_CHARS) & ~F.col("item").rlike(noise)).withColumn("item", scrub_private(F.col("item")))
    cut = lambda n: F.col("item") if n is None else F.substring("item", 1, n)
    return df.withColumn("item", F.when(kind == "text", cut(max_text)).otherwise(cut(max_tool)))


def read_buffer(spark: SparkSession, path: str, pattern: str = "*.jsonl", session: str = r"([^/]+)\.jsonl$") -> tuple[DataFrame, DataFrame]:
    """Events of the session buffers below ``path`` (columns of ``BUFFER``; others are left out), and torn lines."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(BUFFER + ", torn string")
    rows = reader.option("columnNameOfCorruptRecord", "torn").json(path)
    rows = rows.withColumn("session_id", F.regexp_extract(F.col("_metadata.file_path"), session, 1))
    return rows.where("torn IS NULL AND t IS NOT NULL").drop("torn"), rows.where("torn IS NOT NULL").select("session_id", F.coalesce("torn", "t").alias("torn"))  # Spark reads no file for that column alone
