"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all
turns before it as context and only that reply trainable.

The template is ``<turn ROLE>\\nTEXT</turn>\\n`` per turn.  Inside roles and texts a backslash is doubled and
the control strings become backslash codes, so that no text can open or close a turn and reading back gives
exactly what went in.

A conversation's turns are grouped in blocks of ``block_turns`` consecutive turn numbers, which are rendered
once each; an example's text is that of all blocks before its own and of its block up to the reply.  So the
examples of a long conversation grow with the square of its length, as prefixes do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>"
#: Escape codes, longest first when read back.
CODES = {"\\\\": "\\", "\\o": OPEN, "\\c": CLOSE, "\\g": ">", "\\n": "\n"}
_TURN = re.compile(r"<turn ([^>]*)>\n(.*?)</turn>\n", re.S)
_CODE = re.compile(r"\\[\\ocgn]")


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(F.replace(text, F.lit(OPEN), F.lit("\\o")), F.lit(CLOSE), F.lit("\\c"))
    return F.replace(F.replace(text, F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n")) if role else text


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: CODES[m[0]], text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; raises on anything that the template did not write."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}: {formatted[at : at + 40]!r}")
    return turns


def prefix_targets(turns: DataFrame, block_turns: int = 64, target_role: str = "assistant") -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, block, example (position in the block), context_blocks (blocks before it), formatted,
    own_start (code point of ``formatted`` at which the block starts), loss_start and loss_end (code points of
    the reply within ``formatted``; both null for a row without a target) and closes_block.  A block that does not end in a reply gets a last row without target, so that no turn is
    lost.  Turns are ordered by number (null first), then role and text; null roles and texts are empty;
    rows that repeat stay; null conv_ids form one conversation; an empty table gives no rows.
    """
    t = turns.select("conv_id", F.floor(F.col("turn") / block_turns).alias("block"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), escaped(F.col("text")).alias("text")).alias("t"))
    blocks = t.repartition("conv_id").groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rendered = F.transform("ts", lambda t: F.concat(F.lit(OPEN), escaped(t["role"], role=True), F.lit(">\n"), t["text"], F.lit(f"{CLOSE}\n")))
    blocks = blocks.withColumn("rendered", rendered).withColumn("n", F.size("ts"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("own", F.array_join("rendered", "")).withColumn("before", F.collect_list("own").over(earlier)).drop("own")
    blocks = blocks.withColumn("context_blocks", F.size("before").cast("long")).withColumn("before", F.array_join("before", ""))
    at = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.element_at("ts", i)["role"] == target_role) | (i == F.col("n")))
    examples = blocks.withColumn("at", F.explode(at)).withColumn("formatted", F.concat("before", F.array_join(F.slice("rendered", F.lit(1), F.col("at")), "")))
    last = F.element_at("ts", F.col("at"))
    end = F.char_length("formatted") - len(CLOSE) - 1
    hit = last["role"] == target_role
    return examples.select(
        "conv_id", "block", F.col("at").alias("example"), "context_blocks", "formatted", F.char_length("before").alias("own_start"),
        F.when(hit, end - F.char_length(last["text"])).alias("loss_start"), F.when(hit, end).alias("loss_end"), (F.col("at") == F.col("n")).alias("closes_block"),
    )


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back from ``formatted`` and the loss spans alone, a row per conversation.

    The rows of a conversation are sorted and streamed: a task keeps two running hashes, no texts.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"
    sorted_rows = examples.repartition("conv_id").sortWithinPartitions("conv_id", "block", "example")
    sorted_rows = sorted_rows.select("conv_id", "formatted", "own_start", "loss_start", "loss_end", "closes_block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state, done = None, []

        def close():
            if state:
                done.append([state["id"], state["turns"], state["all"].hexdigest(), state["loss"], state["own"].hexdigest(), state["chars"], state["rows"]])

        for batch in batches:
            for conv, text, own, start, end, closes in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or state["id"] != conv:
                    close()
                    state = {"id": conv, "turns": 0, "loss": 0, "chars": 0, "rows": 0, "all": hashlib.sha256(), "own": hashlib.sha256()}
                state["chars"] += len(text)
                if start is not None:
                    reply = unescape(text[start:end])
                    state["rows"] += 1
                    state["loss"] += len(reply)
                    state["own"].update(reply.encode())
                if closes:
                    for role, said in read_turns(text[own:]):
                        state["turns"] += 1
                        state["all"].update(f"{role}\n{said}\n".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    return sorted_rows.mapInArrow(read, schema)
